"""Event-time windows: daily usage, change batches, distinct reports.

The watermark delays bound the state; rows later than the delay are dropped, which
is a choice of these variants (the batch operators and the ledger never drop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(requests: DataFrame, user: str, ts: str, limit: int, delay: str = "1 day") -> DataFrame:
    """Admitted and denied requests per user and closed calendar day."""
    n = F.count(F.lit(1))
    days = requests.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), user).agg(n.alias("_n"))
    return days.select(user, F.to_date("window.start").alias("usage_day"),
                       F.least("_n", F.lit(limit)).alias("request_count"),
                       F.greatest(F.col("_n") - limit, F.lit(0)).alias("denied"))


def change_batches(changes: DataFrame, user: str, ts: str, gap: str = "1200 milliseconds",
                   delay: str = "0 seconds") -> DataFrame:
    """One row per burst of changes, sent ``gap`` after the last change."""
    bursts = changes.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), user)
    return bursts.agg(F.count(F.lit(1)).alias("changes")).select(
        user, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("push_at"), "changes")


def distinct_reports(reports: DataFrame, ts: str, delay: str = "30 days") -> DataFrame:
    """First report of each comment and user within the watermark."""
    return reports.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["comment_id", "user_id"])
