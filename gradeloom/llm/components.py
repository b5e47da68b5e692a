"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.frames import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; root is the smallest node of the component.

    Both steps are a grouped minimum and a join, so a node with many edges is summed before it is
    shuffled and its join partition can be split.  Each round is written to the shared folder.
    """
    def low(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    table = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = table.select("a", "b").union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(low(both), "a").select("a", "b", F.least("a", "m").alias("m")).where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.join(low(down), "a")
        table = written(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
