"""Starting and draining streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gradeloom.session import shared_dir


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with the state store that keyed processors need, then give the setting back."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def drain(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is available into a Parquet folder and read it back.

    Sink and checkpoint lie in ``folder``; naming the same folder again resumes from its checkpoint.
    Without one a fresh folder below the shared root is taken.
    """
    spark = stream.sparkSession
    root = folder or shared_dir(spark, name)
    with rocks_state(spark):
        handle = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out")
                  .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        handle.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def drain_batches(stream: DataFrame, name: str, sink: Callable[[DataFrame, int], None], mode: str = "update", folder: str | None = None) -> None:
    """Process what is available through an idempotent batch function; ``folder`` as in ``drain``."""
    root = folder or shared_dir(stream.sparkSession, name)
    with rocks_state(stream.sparkSession):
        handle = (stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
                  .trigger(availableNow=True).start())
        handle.awaitTermination()


def parquet_stream(spark: SparkSession, folder: str, file_name: str, files_per_trigger: int = 64) -> DataFrame:
    """A folder's Parquet files as a stream, with the schema of the files."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_name)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
