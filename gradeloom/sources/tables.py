"""Text corpora, relational tables and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import base_name, trim_all
from gradeloom.plans.scale import keep_top


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per text file: name, category (name without extension) and whole text."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    named = raw.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    extension = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    return named.select("file_name", base_name(F.col("file_name")).alias("category"), extension.alias("extension"), "text")


def split_pages(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """Pages of texts with ``[[PAGE n]]`` marks; text before the first mark is page 0."""
    parts = F.split(text, r"(?i)\[\[PAGE\s+")
    rows = documents.select(doc, F.posexplode(parts).alias("i", "p"))
    number = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.regexp_extract("p", r"\A([0-9]+)\]\]", 1).cast("int"))
    body = F.when(F.col("i") == 0, F.col("p")).otherwise(F.regexp_replace("p", r"\A[0-9]+\]\]\n?", ""))
    return rows.select(doc, number.alias("page"), body.alias("text")).where(trim_all(F.col("text")) != "")


def choose_page_text(extracted: DataFrame, recognised: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Recognised page text replaces the extracted one only when it is longer."""
    other = recognised.select(*keys, F.col(text).alias("_ocr"))
    longer = F.coalesce(F.length("_ocr") > F.length(text), F.lit(False))
    return extracted.join(other, keys, "left").withColumn(text, F.when(longer, F.col("_ocr")).otherwise(F.col(text))).drop("_ocr")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows after inserting or replacing by key; among equal keys the incoming row wins."""
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return keep_top(both, keys, [F.col("_side").desc(), *(order or [])]).drop("_side")


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows after inserting only new keys."""
    fresh = keep_top(incoming.join(current.select(*keys), keys, "left_anti"), keys, order)
    return current.unionByName(fresh)


def write_version(table: DataFrame, root: str, version: int) -> str:
    """A new version folder; readers switch once it is complete."""
    path = f"{root}/version={version}"
    table.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One version of a table, the latest by default; only its own folder is read.

    Files of a write that has not been committed are not visible, so an unfinished version is never the latest.
    """
    table = spark.read.parquet(root)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version).drop("version")


def append_log(rows: DataFrame, path: str, day: str) -> None:
    """Append-only log partitioned by day."""
    rows.write.mode("append").partitionBy(day).parquet(path)
