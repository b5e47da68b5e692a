"""Daily quotas and request rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom import fixed as V
from gradeloom.plans.scale import bounded_lookback, keep_top


def within_daily_quota(requests: DataFrame, user: str, ts: str, seq: str,
                       limit: int = V.DAILY_LIMIT) -> DataFrame:
    """Requests admitted before the learner's daily count reaches ``limit``."""
    dated = requests.withColumn("usage_day", F.to_date(ts))
    return keep_top(dated, [user, "usage_day"], [F.col(ts), F.col(seq)], limit, rank="used")


def daily_usage(requests: DataFrame, user: str, ts: str, limit: int = V.DAILY_LIMIT) -> DataFrame:
    """Stored counter and denied requests per learner and day."""
    n = F.count(F.lit(1))
    return requests.groupBy(user, F.to_date(ts).alias("usage_day")).agg(
        F.least(n, F.lit(limit)).alias("request_count"),
        F.greatest(n - limit, F.lit(0)).alias("denied"))


def request_rate(requests: DataFrame, keys: list[str], ts: str, width_us: int) -> DataFrame:
    """Requests of the same key in the half-open past ``width_us`` of each request."""
    return bounded_lookback(requests, keys, F.unix_micros(ts), width_us, {"recent": F.count(F.lit(1))})


def idle_runs(requests: DataFrame, keys: list[str], micros: str, seq: str, gap_us: int,
              slice_us: int = 3_600_000_000) -> DataFrame:
    """Add ``run``: start of the stretch without a pause of ``gap_us`` or more.

    Stretches are found inside time slices; one row per slice is ordered over the key
    to tell which stretch is still open when a slice begins.
    """
    slot = [*keys, "_slice"]
    local = Window.partitionBy(*slot).orderBy(micros, seq)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    sliced = requests.withColumn("_slice", F.floor(F.col(micros) / slice_us))

    def starts(df: DataFrame) -> DataFrame:
        prev = F.lag(micros).over(local)
        begin = F.when(prev.isNull() | (F.col(micros) - prev >= gap_us), F.col(micros))
        return df.withColumn("_start", begin).withColumn("_local", F.last("_start", True).over(so_far)).drop("_start")

    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = starts(sliced.select(*slot, micros, seq)).groupBy(*slot).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_end"), F.max("_local").alias("_last"))
    slices = slices.withColumn("_carry", F.max("_end").over(before))
    joins = F.col("_carry").isNotNull() & (F.col("_first") - F.col("_carry") < gap_us)
    opened = F.when(~joins | (F.col("_last") > F.col("_first")), F.col("_last"))
    slices = slices.withColumn("_opened", F.last(opened, True).over(before)).select(
        *slot, "_first", F.when(joins, F.col("_opened")).alias("_open"))
    rows = starts(sliced).join(slices, slot)
    run = F.when((F.col("_local") == F.col("_first")) & F.col("_open").isNotNull(), F.col("_open")).otherwise(F.col("_local"))
    return rows.withColumn("run", run).drop("_slice", "_local", "_first", "_open")


def change_batches(changes: DataFrame, user: str, ts: str, seq: str, gap_us: int) -> DataFrame:
    """Bursts of changes: one batch per stretch whose pauses are shorter than ``gap_us``."""
    rows = idle_runs(changes.withColumn("_us", F.unix_micros(ts)), [user], "_us", seq, gap_us)
    return rows.groupBy(user, "run").agg(
        F.max("_us").alias("last_us"), F.count(F.lit(1)).alias("changes")
    ).select(user, F.col("run").alias("first_us"), (F.col("last_us") + gap_us).alias("push_us"), "changes")
