"""Bank, test and learning-record packages as JSON.

A package is one JSON document per file.  The accepted format tags are arguments,
so that packages of any producer can be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom import schemas as S
from gradeloom.operators.library import nest_questions


def read_bank_packages(spark: SparkSession, path: str, formats: list[str], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted packages and rejects (``file``, ``reason``); with ``lines`` every line is a package, else every file.

    Accepted rows hold name, description, group and the usable questions.
    """
    raw = (spark.read.schema(S.BANK_PACKAGE).option("multiLine", not lines).json(path)
           .select("*", F.col("_metadata.file_path").alias("file")))
    usable = F.filter(F.coalesce("bank.questions", F.array().cast(f"array<{S.QUESTION_STRUCT}>")), lambda q:
                      q["stem"].isNotNull() & q["options"].isNotNull() & q["answer"].isNotNull())
    checked = raw.withColumn("questions", usable)
    known = F.coalesce(F.col("format").isin(formats) & (F.col("version") == 1), F.lit(False)) & F.col("bank.questions").isNotNull()
    reason = F.when(~known, "format").when(F.size("questions") == 0, "no_questions")
    checked = checked.withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).select(
        "file", F.coalesce("bank.name", F.lit("")).alias("name"),
        F.coalesce("bank.description", F.lit("")).alias("description"),
        F.coalesce("bank.groupName", F.lit("")).alias("group_name"), "exportedAt", "questions")
    return good, checked.where(F.col("reason").isNotNull()).select("file", "reason")


def explode_questions(packages: DataFrame, key: str = "file") -> DataFrame:
    return packages.select(key, F.posexplode("questions").alias("pos", "q")).select(key, "pos", "q.*")


def write_bank_packages(banks: DataFrame, questions: DataFrame, path: str, format_tag: str, exported_at: str,
                        reports: DataFrame | None = None, columns: list[str] | None = None) -> None:
    """One JSON line per bank (banks beyond the question cap become several parts)."""
    columns = columns or ["id", "sourceNumber", "category", "stem", "options", "answer"]
    nested = nest_questions(questions, "bank_id", "pos", columns)
    out = banks.withColumnRenamed("id", "bank_id").join(nested, "bank_id")
    if reports is not None:
        out = out.join(reports.select("bank_id", "report"), "bank_id", "left")
    else:
        out = out.withColumn("report", F.lit(None).cast("string"))
    packed = F.transform("questions", lambda q: F.struct(*[q[c].alias(c) for c in columns]))
    out.select(F.lit(format_tag).alias("format"), F.lit(1).alias("version"), F.lit(exported_at).alias("exportedAt"), "report",
               F.struct("name", "description", F.col("group_name").alias("groupName"), packed.alias("questions")).alias("bank")
               ).write.mode("overwrite").json(path)


def read_test_packages(spark: SparkSession, path: str, format_tag: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """English tests with a name and sections; an unknown stage becomes the default."""
    raw = (spark.read.schema(S.ENGLISH_PACKAGE).option("multiLine", not lines).json(path)
           .select("*", F.col("_metadata.file_path").alias("file")))
    ok = (F.coalesce(F.col("format") == format_tag, F.lit(False)) & (F.coalesce("test.name", F.lit("")) != "")
          & (F.coalesce(F.size("test.sections"), F.lit(0)) > 0))
    stage = F.when(F.col("test.stage").isin(V.STAGES), F.col("test.stage")).otherwise(V.STAGES[0])
    good = raw.where(ok).select(
        "file", "test.name", stage.alias("stage"), "test.examVariant", F.lit("json").alias("sourceFormat"),
        F.coalesce("test.usedOcr", F.lit(False)).alias("usedOcr"), "test.answerSourceName", "test.sections")
    return good, raw.where(~ok).select("file", F.lit("format").alias("reason"))


def write_test_packages(tests: DataFrame, path: str, format_tag: str, exported_at: str) -> None:
    columns = ["name", "stage", "examVariant", "usedOcr", "answerSourceName", "sections"]
    tests.select(F.lit(format_tag).alias("format"), F.lit(exported_at).alias("exportedAt"),
                 F.struct(*columns).alias("test")).write.mode("overwrite").json(path)


def write_records(states: DataFrame, path: str, product: str, exported_at: str) -> None:
    """Learning records ``user_id, state`` as JSON lines."""
    states.select(F.lit(product).alias("product"), F.lit(2).alias("version"), F.lit(exported_at).alias("exportedAt"),
                  "user_id", "state").write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """States to merge, one row per export, and rejects (``file``, ``user_id``, ``reason``)."""
    rows = spark.read.schema(S.RECORD_EXPORT).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("state")).startswith("OBJECT"), F.lit(False))
    return (rows.where(good).select("user_id", "exportedAt", F.col("state").alias("payload")),
            rows.where(~good).select("file", "user_id", F.lit("state").alias("reason")))
