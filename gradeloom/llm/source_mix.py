"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source, targets are filled up by weight to the ceiling, and a document is
taken floor(rate) times, and once more if a hash-seeded draw in [0, 1) is below the fraction of
its source's rate.  Only the table of sources is aggregated; documents meet it in one join.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
sources without words have target 0 and rate 0; a null id draws by its text; equal rows draw
alike; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.llm.frames import free_name, written

WEIGHTS = (3, 1, 2)
SHARE, CEILING, SEED = 1.5, 2, "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def ranked(sources: DataFrame, order: str) -> DataFrame:
    """A 0-based ``position`` in the order of ``order``, nulls last, without one task holding every row.

    Rows are numbered inside range partitions; the offsets of the partitions are added.
    """
    spread = written(sources.repartitionByRange(F.col(order).asc_nulls_last()).sortWithinPartitions(F.col(order).asc_nulls_last())
                     .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    spread = spread.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    offsets = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (spread.join(offsets.select("_part", "_before"), "_part")
            .withColumn("position", F.col("_row") + F.col("_before")).drop("_at", "_part", "_row", "_before"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares by weight, cut at the ceiling until none is above.

    Each round is one aggregate over the table of sources; the set at the ceiling only grows.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    table = written(ranked(sources, "source").withColumn("weight", weight), "sources")
    cap, level = F.col("source_size") * ceiling, 0.0
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = cap.cast("double") < F.lit(level) * F.col("weight")
        used, free = table.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        higher = (share * total - (used or 0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight"))).drop("weight", "position")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS,
          share: float = SHARE, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (how often the mix holds the row)."""
    fresh = ("size", "source_size", "target", "rate", "copies")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in fresh])
    key = free_name(docs.columns, "mix_key")
    sized = docs.withColumn("size", word_count(F.col(text)))
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    goals = targets(per, weights, share, ceiling)
    lookup = goals.select(F.col("source").alias(key), "source_size", "target",
                          F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    joined = sized.join(lookup, F.col(f"`{source}`").eqNullSafe(F.col(key)), "left").drop(key)
    whole = F.floor("rate")
    extra = (draw(F.col(doc_id), F.col(text), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra)


def repeated(mix: DataFrame) -> DataFrame:
    """The mix itself: every row ``copies`` times."""
    at = free_name(mix.columns, "copy")
    return mix.where("copies > 0").withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(at)
