"""Plan building blocks that keep operators safe on hot keys."""
