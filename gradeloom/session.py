"""Session settings the operators rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Timestamps are compared with UTC-naive data.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text work is bound by CPU, not bytes: keep small shuffles spread over the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Split hot join keys even when that costs one more exchange after the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts go to Python by bytes, not by 10,000 rows however long.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


INITIAL, ADVISED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere; what ``size_shuffles`` set for an earlier query ends."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key in (INITIAL, ADVISED):
        before = spark.conf.get(f"spark.gradeloom.before.{key}", None)
        if before is not None:
            spark.conf.unset(f"spark.gradeloom.before.{key}")
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark


def size_shuffles(spark: SparkSession, rows: int, per_task: int = 250_000) -> None:
    """Let the shuffles of a query of so many rows begin with a partition per ``per_task`` rows.

    A fixed number of partitions makes the sorts and hash maps of a task grow with the input.  Adaptive execution joins
    small partitions up to 16 MB and still splits hot keys.
    """
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for key, value in ((INITIAL, max(-(-rows // per_task), fixed)), (ADVISED, "16m")):
        if spark.conf.get(f"spark.gradeloom.before.{key}", None) is None:
            spark.conf.set(f"spark.gradeloom.before.{key}", spark.conf.get(key, None) or "")
        spark.conf.set(key, str(value))


def local_session(name: str = "gradeloom", cpus: str | int = "*") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", os.environ.get("GRADELOOM_PARTITIONS", "8"))
        .config("spark.driver.memory", os.environ.get("GRADELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.gradeloom.text.partitions", os.environ.get("GRADELOOM_PARTITIONS", "8"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``.  A cluster without that setting is refused; a session on
    one machine (``local``), as in tests, takes a folder in its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root; runs of different applications never meet."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
