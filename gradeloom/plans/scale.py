"""Building blocks for ordered work over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole group into one task.  Where the
group can be large the helpers here split it:

* ``keep_top``      rank filter; Spark pushes the limit below the shuffle
                    (``WindowGroupLimit``), so a hot key ships at most k rows per map task.
* ``running``       running sum / max / last value, computed per (key, block) and
                    joined with the prefix of the much smaller block totals.
* ``bounded_lookback`` range window whose frame is bounded, computed per time slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.session import shared_dir


def keep_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
             rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group; ``order`` must be total."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def running(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
            specs: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Running values over ``order`` within ``keys``.

    ``block`` is a non-decreasing function of the order columns that cuts a group
    into slices small enough for one task.  ``specs`` maps an output name to
    ``(kind, column)`` with kind ``sum``, ``max`` or ``last`` (latest non-null).
    With ``before=True`` the current row is left out of its own value.
    """
    keys = list(keys)
    slot = [*keys, "_block"]
    base = df.withColumn("_block", block)
    for name, (_, column) in specs.items():
        base = base.withColumn(f"_in_{name}", column)

    stop = -1 if before else 0
    local = (Window.partitionBy(*slot).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, stop))
    rows = base
    for name, (kind, _) in specs.items():
        value = F.col(f"_in_{name}")
        agg = {"sum": F.sum(value), "max": F.max(value),
               "last": F.last(value, ignorenulls=True)}[kind]
        rows = rows.withColumn(f"_loc_{name}", agg.over(local))

    position = F.struct(*[F.col(c) for c in order])
    totals = base.groupBy(*slot).agg(*[
        {"sum": F.sum(f"_in_{n}"), "max": F.max(f"_in_{n}"),
         "last": F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), position))}[kind]
        .alias(f"_tot_{n}")
        for n, (kind, _) in specs.items()
    ])
    earlier = (Window.partitionBy(*keys).orderBy("_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    prefix = totals.select(*slot, *[
        {"sum": F.sum(f"_tot_{n}"), "max": F.max(f"_tot_{n}"),
         "last": F.last(f"_tot_{n}", ignorenulls=True)}[kind].over(earlier).alias(f"_pre_{n}")
        for n, (kind, _) in specs.items()
    ])
    joined = rows.join(prefix, slot, "left")
    for name, (kind, _) in specs.items():
        here, prev = F.col(f"_loc_{name}"), F.col(f"_pre_{name}")
        value = {"sum": F.coalesce(here, F.lit(0)) + F.coalesce(prev, F.lit(0)),
                 "max": F.greatest(here, prev),
                 "last": F.coalesce(here, prev)}[kind]
        joined = joined.withColumn(name, value)
    extra = ["_block"] + [f"_{p}_{n}" for n in specs for p in ("in", "loc", "pre")]
    return joined.drop(*extra)


def numbered(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str],
             name: str) -> DataFrame:
    """Dense 1-based row number within ``keys``, block by block."""
    return running(df, keys, block, order, {name: ("sum", F.lit(1))})


def numbered_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Dense 1-based row number within ``keys`` where the order has no blocks of its own.

    Rows are written in sorted ranges of (keys, order), so rows of one key, or equal in all but the last
    order column, spread over tasks; only one row per key and range is ordered over the key.
    """
    spark = df.sparkSession
    columns = [F.col(k) for k in keys]
    root = shared_dir(spark, "ranges")
    spread = df.repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order).withColumn("_at", F.monotonically_increasing_id())
    spread.write.parquet(root)
    spread = spark.read.schema(spread.schema).parquet(root).withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spread.groupBy(*keys, "_range").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select(F.struct(*keys, "_range").alias("_own"), "_low", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    met = spread.join(ranges, F.struct(*columns, F.col("_range")).eqNullSafe(F.col("_own")))
    return met.withColumn(name, F.col("_before") + F.col("_at") - F.col("_low") + 1).drop("_at", "_range", "_own", "_low", "_before")


def bounded_lookback(df: DataFrame, keys: Sequence[str], micros: Column, width_us: int,
                     aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the half-open past ``(t - width, t]`` of each row.

    Every row is placed in its own time slice of that width and, as context, in the
    next one; a window then never spans more than two widths of one key.
    """
    base = df.withColumn("_us", micros)
    base = base.withColumn("_home", F.floor(F.col("_us") / width_us))
    both = base.withColumn("_slice", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    window = (Window.partitionBy(*keys, "_slice").orderBy("_us")
              .rangeBetween(-(width_us - 1), 0))
    for name, agg in aggregates.items():
        both = both.withColumn(name, agg.over(window))
    return both.where("_slice = _home").drop("_us", "_home", "_slice")
