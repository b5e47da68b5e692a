"""Streaming ledger: change rows to a mergeable log, merged when read.

Every micro-batch is reduced on its own and written to its own folder, so a
replayed batch overwrites itself.  Last-writer-wins fields are merged before the
write; results of the first-result field are kept (distinct), because a later
reset may uncover any of them.  No update is ever dropped for being late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.operators.sync import KEY, first_result, merge_latest, merge_ledgers
from gradeloom.streaming import snapshot
from gradeloom.streaming.run import drain_batches


def reduce_rows(ledger: DataFrame) -> DataFrame:
    """The rows of a ledger that can still matter to a later merge."""
    columns = [*KEY, "value", "updated_at", "seq"]
    firsts = (ledger.where("field = 'firstProgress'").groupBy(*KEY, "value", "updated_at").agg(F.max("seq").alias("seq")))
    return merge_latest(ledger).select(*columns).unionByName(firsts.select(*columns))


def append_batch(root: str):
    """Batch function for ``foreachBatch``: one folder per batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        reduce_rows(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return write


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop("batch")


def compact(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Write the log's reduced rows as batch 0 of a new root."""
    reduce_rows(read_log(spark, root)).write.mode("overwrite").parquet(f"{target}/batch=0")
    return read_log(spark, target)


def drain_ledger(stamps: DataFrame, root: str) -> DataFrame:
    """Run a change stream into the log and return the merged ledger."""
    drain_batches(stamps, "ledger", append_batch(root), mode="append")
    return merge_ledgers(read_log(stamps.sparkSession, root))


def latest_results(stamps: DataFrame) -> DataFrame:
    """Native streaming aggregate: current value per user, question and field (update mode)."""
    at = F.struct("updated_at", "seq")
    return stamps.groupBy(*KEY).agg(F.max_by("value", at).alias("value"), F.max(at).alias("at"))


def open_results(rows: DataFrame) -> DataFrame:
    """The rows (user_id, question_id, value, seq) that a later reset can still bring to light: the last reset and what follows it."""
    keys = ["user_id", "question_id"]
    reset = F.max(F.when(F.col("value").isNull(), F.col("seq"))).over(Window.partitionBy(*keys))
    alive = F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")) | (F.col("value").isNull() & (F.col("seq") == F.col("_reset")))
    return rows.withColumn("_reset", reset).where(alive).select(*keys, "value", "seq").distinct()


def drain_firsts(stamps: DataFrame, root: str) -> DataFrame:
    """Run result changes into a versioned snapshot and return the first result of every learner and question.

    A batch is merged as whole tables in the buckets it touches; no key has a state or a call of its own.
    """
    keys = ["user_id", "question_id"]
    rows = snapshot.drain_snapshot(stamps, root, keys, open_results)
    return first_result(rows, keys, ["seq"], updated_at="seq")
