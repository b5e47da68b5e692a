"""A corpus pipeline: each stage reads what the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import chosen_path, language_bits, personal_data, source_mix, wu_manber
from gradeloom.llm.frames import table, written

#: Texts that Spark hands to a Python worker at once; bounds what both sides hold.
BATCH_ROWS = 1000
#: A text whose two best languages are level, or that holds no n-gram of any, is of no language.
LEVEL_SCORE = 0.5


def batches(stage):
    """``stage`` in a session whose Arrow batches have at most ``BATCH_ROWS`` rows, for memory on both sides."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)
    return run_stage


@batches
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, without a known n-gram, or level between two languages, go."""
    found = language_bits.identify(docs, language_bits.fit(docs))
    return found.where((F.col("lang_pred") != language_bits.UNKNOWN) & (F.col("score") > LEVEL_SCORE)).select(docs.columns)


@batches
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id."""
    return chosen_path.one_of_each(docs).select(docs.columns)


@batches
def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = wu_manber.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


@batches
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; ``n_chars`` follows the new text."""
    found = personal_data.masked(docs, personal_data.train(personal_data.labelled_table(spark)))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that the sources meet their target weights."""
    return source_mix.repeated(source_mix.mixed(docs))


STAGES = [
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark_texts),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
]

#: Language filters, sketches and the tagger have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
