"""Questions recovered from structured (JSON) responses."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gradeloom import fixed as V
from gradeloom.functions.answers import options_first_wins, valid_answer
from gradeloom.functions.text import first_int, trim_all
from gradeloom.operators.blueprint import section_at
from gradeloom.operators.curate import dedupe_structured
from gradeloom.plans.scale import keep_top

TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[\[\]{}]', re.S)
ARRAY_START = re.compile(r'"questions"\s*:\s*\[')
ITEM = ("sourceNumber string, stem string, options array<struct<label:string,text:string>>, answer string, "
        "questionType string, sharedOptionGroup string, explanation string, answerSource string")


def _load(text: str):
    def refuse(name: str):
        raise ValueError(name)
    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


def _objects(text: str, start: int, in_array: bool) -> Iterator[str]:
    """Balanced {...} texts: children of the array at ``start``, or top-level objects."""
    depth = brackets = 0
    begin = -1
    for token in TOKEN.finditer(text, start):
        mark = token.group()
        if mark == "[" and in_array:
            brackets += 1
        elif mark == "]" and in_array:
            brackets -= 1
            if brackets == 0:
                return
        elif mark == "{" and (not in_array or brackets == 1):
            if depth == 0:
                begin = token.start()
            depth += 1
        elif mark == "}" and depth > 0:
            depth -= 1
            if depth == 0:
                yield text[begin:token.end()]


def candidate_items(content: str) -> list[str]:
    """Every question-like object that can be read from a response, damaged parts skipped."""
    text = re.sub(r"```(?:jsonl|ndjson|json)?", "", content.removeprefix("\ufeff"), flags=re.I).strip()
    found: list = []

    def children(value) -> list:
        items = value.get("questions") if isinstance(value, dict) else None
        return items if isinstance(items, list) else []

    def question_like(value) -> bool:
        return isinstance(value, dict) and ("stem" in value or ("sourceNumber" in value and "answer" in value))

    first, last = text.find("{"), text.rfind("}")
    for piece in (text, text[first:last + 1] if 0 <= first < last else ""):
        value = _load(piece) if piece else None
        found += value if isinstance(value, list) else children(value)
    for line in text.split("\n"):
        line = line.strip().strip(", \t\r")
        if line.startswith("{") and line.endswith("}"):
            value = _load(line)
            if isinstance(value, dict):
                typed = value.get("type") == "question" or question_like(value)
                found += children(value) if isinstance(value.get("questions"), list) else [value] if typed else []
    for mark in ARRAY_START.finditer(text):
        found += [v for v in map(_load, _objects(text, mark.end() - 1, True)) if v is not None]
    for value in map(_load, _objects(text, 0, False)):
        if isinstance(value, dict):
            found += children(value) if isinstance(value.get("questions"), list) else [value] if question_like(value) else []
    return [json.dumps(v, ensure_ascii=False) for v in found]


@F.pandas_udf(ArrayType(StringType()))
def recover_items(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [] if c is None else candidate_items(c))


def recovered(responses: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per recovered item: keys, ``idx`` and the raw JSON ``item``."""
    return responses.select(*keys, F.posexplode(recover_items(F.col(content))).alias("idx", "item"))


def _label(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), pattern, 0)


def normalize_items(items: DataFrame, keys: list[str], profiled: Column, allow_unanswered: bool = False,
                    exam_year: Column | None = None, exam_format: Column | None = None,
                    sections: Column | None = None) -> DataFrame:
    """Typed questions from recovered items; unusable items carry ``usable = false``."""
    raw = F.from_json("item", ITEM)
    rows = items.withColumn("r", raw)
    cleaned = F.transform(F.coalesce("r.options", F.array().cast("array<struct<label:string,text:string>>")),
                          lambda o: F.struct(_label(o["label"], "[A-G]").alias("label"),
                                             trim_all(F.coalesce(o["text"], F.lit(""))).alias("text")))
    rows = rows.withColumn("options", options_first_wins(F.filter(cleaned, lambda o: (o["label"] != "") & (o["text"] != ""))))
    letters = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce("r.answer", F.lit(""))), F.lit("[A-G]"), F.lit(0)))
    rows = rows.withColumn("answer", valid_answer(letters, F.col("options")))
    rows = rows.withColumn("stem", trim_all(F.coalesce("r.stem", F.lit(""))))
    rows = rows.withColumn("source_number", F.coalesce(F.nullif(trim_all(F.col("r.sourceNumber")), F.lit("")),
                                                       (F.col("idx") + 1).cast("string")))
    band = section_at(first_int(F.col("source_number")), sections) if sections is not None else None
    inferred = F.when(profiled, band["question_type"]) if band is not None else F.lit(None).cast("string")
    supplied = F.nullif(_label(F.col("r.questionType"), "[ABCX]"), F.lit(""))
    modern = (exam_format == V.MODERN) if exam_format is not None else F.lit(False)
    kind = F.when(modern, F.coalesce(inferred, supplied)).otherwise(F.coalesce(supplied, inferred))
    usable = (F.col("stem") != "") & (F.size("options") >= 2)
    if not allow_unanswered:
        usable = usable & (F.size("answer") > 0)

    def given(field: str) -> Column:
        return F.nullif(trim_all(F.col(f"r.{field}")), F.lit(""))

    rows = rows.withColumn("question_type", kind)
    return rows.select(
        *keys, "idx", "source_number", "stem", "options", "answer", (F.size("answer") == 0).alias("answer_pending"),
        (F.coalesce(F.col("question_type") == "X", F.lit(False)) | (F.size("answer") > 1)).alias("multiple"),
        F.when(profiled, V.PROFILE).alias("exam_profile"),
        (F.when(profiled, exam_year) if exam_year is not None else F.lit(None).cast("int")).alias("exam_year"),
        (F.when(profiled, exam_format) if exam_format is not None else F.lit(None).cast("string")).alias("exam_format"),
        "question_type",
        (F.when(profiled, band["points"]) if band is not None else F.lit(None).cast("double")).alias("points"),
        given("sharedOptionGroup").alias("shared_option_group"), given("explanation").alias("explanation"),
        given("answerSource").alias("answer_source"), usable.alias("usable"))


def parse_responses(responses: DataFrame, keys: list[str], profiled: Column, **options) -> DataFrame:
    """Recovered, normalised and de-duplicated questions of every response."""
    rows = normalize_items(recovered(responses, keys), keys, profiled, **options).where("usable").drop("usable")
    paper = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    return dedupe_structured(rows.withColumn("_paper", paper), "_paper", "idx").drop("_paper")


def answer_patches(responses: DataFrame, targets: DataFrame, bank: str) -> DataFrame:
    """Answer patches for target questions by source number; the last one wins."""
    rows = recovered(responses, [bank]).withColumn("r", F.from_json("item", ITEM))
    rows = rows.withColumn("source_number", trim_all(F.coalesce("r.sourceNumber", F.lit(""))))
    aim = targets.select(bank, trim_all(F.col("source_number")).alias("source_number"), "options")
    letters = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce("r.answer", F.lit(""))), F.lit("[A-G]"), F.lit(0)))
    hits = rows.join(aim, [bank, "source_number"]).withColumn("answer", valid_answer(letters, F.col("options"))).where(F.size("answer") > 0)
    last = keep_top(hits, [bank, "source_number"], [F.col("idx").desc()])
    return last.select(bank, "source_number", F.col("idx").alias("seq"), "answer",
                       F.nullif(trim_all(F.col("r.explanation")), F.lit("")).alias("explanation"),
                       F.nullif(trim_all(F.col("r.answerSource")), F.lit("")).alias("answer_source"))
