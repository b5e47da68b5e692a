"""Column expressions: text, answers, privacy."""
