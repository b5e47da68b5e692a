"""Registered queries over the driver's tables, each next to its check SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

MODULES = ["learning", "syncing", "library", "discussion", "searching", "papers", "reading", "english", "streams"]


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``check`` is the equivalent DuckDB SQL."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from gradeloom.session import tune
            return fn(Tables(tune(spark), sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return fn
    return add


class Tables:
    """Lazy access to the Parquet tables of one scale directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._schemas = {}

    def texts(self, table: str = "documents") -> DataFrame:
        """A text table; ``spark.gradeloom.text.partitions`` of the session, where set, is the number of tasks it is dealt to.

        Set it for files of few row groups on many cores.  Unset, no text is shuffled.
        """
        rows = getattr(self, table)
        tasks = self.spark.conf.get("spark.gradeloom.text.partitions", None)
        return rows.repartition(int(tasks)) if tasks else rows

    def spread(self, table: str, rows: int = 500) -> DataFrame:
        """A table of narrow rows that each cost much to work on, dealt to tasks of about ``rows`` rows.

        A file of few bytes is one split however long its rows take; the number of tasks grows with the table.
        """
        frame = getattr(self, table)
        return frame.repartition(max(-(-frame.count() // rows), self.spark.sparkContext.defaultParallelism))

    def size_by(self, table: str) -> None:
        """The shuffles of this query grow with the rows of a table, so that a task's memory does not."""
        from gradeloom.session import size_shuffles
        size_shuffles(self.spark, getattr(self, table).count())

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        file = f"{self.path}/{table}.parquet"
        if table not in self._schemas:  # read the footer once per query
            self._schemas[table] = self.spark.read.parquet(file).schema
        return self.spark.read.schema(self._schemas[table]).parquet(file)


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"gradeloom.catalog.{module}")
