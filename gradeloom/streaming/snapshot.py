"""Versioned snapshot of streamed state, merged batch by batch.

Rows lie in buckets of their key.  A micro-batch reads the buckets it touches, merges its rows into them and
writes them under its own version; the other buckets stay where they are.  A manifest per version says at
which version each bucket is; it is written last, so a version is seen whole or not at all.  A batch that
is replayed finds its manifest and changes nothing.  No row is ever dropped for being late: what
``merge`` makes of it does not depend on when it comes.

    data/version=7/bucket=3/...     rows of bucket 3 as of version 7
    manifests/version=7/...         (bucket, at) of every bucket
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradeloom.plans.scale import keep_top
from gradeloom.streaming.run import drain_batches

#: Buckets of a snapshot; a manifest has a row for each, and no more are ever listed.
BUCKETS = 64

Merge = Callable[[DataFrame], DataFrame]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[int, int]:
    """Version of every bucket, as of ``version`` or the newest; empty before the first."""
    try:
        rows = spark.read.schema("bucket int, at bigint, version bigint").parquet(f"{root}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    upto = rows.where(F.col("version") <= version) if version is not None else rows
    newest = upto.agg(F.max("version")).first()[0]
    return {r.bucket: r["at"] for r in rows.where(F.col("version") == newest).collect()} if newest is not None else {}


def versions(spark: SparkSession, root: str) -> list[int]:
    try:
        return sorted(r.version for r in spark.read.schema("bucket int, at bigint, version bigint").parquet(f"{root}/manifests").select("version").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def read_snapshot(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an older one; only files of that version's buckets are listed."""
    return _read(spark, root, schema, manifest(spark, root, version))


def _read(spark: SparkSession, root: str, schema, at: dict[int, int]) -> DataFrame:
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/version={v}/bucket={b}" for b, v in sorted(at.items())])


def merge_batch(root: str, keys: Sequence[str], merge: Merge, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch function for ``foreachBatch``.

    ``merge`` makes the rows to keep of old and new rows.  It takes its own rows again, works on each key apart
    and gives the same for any order and grouping of what comes.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in versions(spark, root):
            return
        before = manifest(spark, root, batch_id)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = merge(batch).persist()
        try:
            touched = {r[0] for r in fresh.select(bucket).distinct().collect()}
            if not touched:
                return
            old = _read(spark, root, fresh.schema, {b: v for b, v in before.items() if b in touched})
            merge(old.unionByName(fresh)).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/version={batch_id}")
        finally:
            fresh.unpersist()
        now = before | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, at bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/version={batch_id}")
    return write


def drain_snapshot(stream: DataFrame, root: str, keys: Sequence[str], merge: Merge, buckets: int = BUCKETS) -> DataFrame:
    """Run a stream into the snapshot and return its newest version; the same ``root`` again resumes."""
    drain_batches(stream, "snapshot", merge_batch(root, keys, merge, buckets), mode="append", folder=f"{root}/stream")
    return read_snapshot(stream.sparkSession, root, merge(stream.sparkSession.createDataFrame([], stream.schema)).schema)


def newest(keys: Sequence[str]) -> Merge:
    """Merge that keeps the row of the latest batch for every key."""
    return lambda rows: keep_top(rows, keys, [F.col("_batch").desc()])


def drain_updates(stream: DataFrame, root: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Run a stream in update mode and return the current row of every key; older rows are merged away batch by batch."""
    write = merge_batch(root, keys, newest(keys), buckets)
    drain_batches(stream, "updates", lambda batch, number: write(batch.withColumn("_batch", F.lit(number).cast("bigint")), number), folder=f"{root}/stream")
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    return read_snapshot(stream.sparkSession, root, schema).drop("_batch")


def summed(keys: Sequence[str], counts: Sequence[str]) -> Merge:
    """Merge that adds up ``counts`` of equal ``keys``."""
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def largest(keys: Sequence[str], column: str) -> Merge:
    """Merge that keeps the largest ``column`` of equal ``keys``."""
    return lambda rows: rows.groupBy(*keys).agg(F.max(column).alias(column))


def joined_bursts(key: str, gap_us: int) -> Merge:
    """Merge of bursts (key, first_us, last_us, changes): those less than ``gap_us`` apart become one.

    The rows of a key are bursts, not changes, so there are as many as its pauses.
    """
    from pyspark.sql.window import Window

    def merge(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy("first_us", "last_us")
        reach = F.max("last_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(reach.isNull() | (F.col("first_us") - reach >= gap_us), 1).otherwise(0)
        numbered = rows.groupBy(key, "first_us", "last_us").agg(F.sum("changes").alias("changes")).withColumn("_new", new)
        numbered = numbered.withColumn("_burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(key, "_burst").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("changes").alias("changes")).drop("_burst")
    return merge
