"""Exam profile, blueprint detection and number bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.text import bind

SECTION_TYPE = "array<struct<question_type:string,start:int,end:int,points:double>>"


def section_case(number: Column, sections: list[tuple], field: int) -> Column:
    """Value of the first band holding ``number``; a CASE, so no range join is planned."""
    out = F.lit(None)
    for section in reversed(sections):
        value = F.lit(section[field]) if len(section) > field else F.lit(None)
        out = F.when(number.between(section[1], section[2]), value).otherwise(out)
    return out


def section_at(number: Column, sections: Column) -> Column:
    """First band of a per-paper section array holding ``number``."""
    return bind(number, lambda n: F.get(F.filter(sections, lambda s: n.between(s["start"], s["end"])), F.lit(0)))


def sections_literal(sections: list[tuple]) -> Column:
    return F.array(*[
        F.struct(F.lit(s[0]).alias("question_type"), F.lit(s[1]).alias("start"), F.lit(s[2]).alias("end"),
                 F.lit(float(s[3]) if len(s) > 3 else None).cast("double").alias("points"))
        for s in sections]).cast(SECTION_TYPE)


def is_profiled(name: Column, text: Column) -> Column:
    sample = F.concat(name, F.lit("\n"), text)
    return sample.rlike(V.PROFILE_PATTERN)


def detect_blueprint(papers: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """Year, format, expected count, total points and sections of every paper."""
    sample = F.concat_ws("\n", name, text)
    dashed = F.regexp_replace(F.translate(F.col("_sample"), "\r", ""), "[—–~～至]", "-")
    range_pattern = rf"(?i)([ABCX]){V.WS}*型题[\s\S]{{0,180}}?([0-9]{{1,3}}){V.WS}*-{V.WS}*([0-9]{{1,3}})"
    found = F.transform(
        F.regexp_extract_all(F.col("_dashed"), F.lit(range_pattern), F.lit(0)),
        lambda hit: F.struct(
            F.upper(F.regexp_extract(hit, range_pattern, 1)).alias("question_type"),
            F.regexp_extract(hit, range_pattern, 2).cast("int").alias("start"),
            F.regexp_extract(hit, range_pattern, 3).cast("int").alias("end"),
            F.lit(None).cast("double").alias("points")))
    usable = F.filter(found, lambda s: (s["start"] >= 1) & (s["end"] >= s["start"]) & (s["end"] <= 300))
    # First section of each type, ordered by start.
    first = bind(usable, lambda found: bind(
        F.transform(found, lambda s: s["question_type"]),
        lambda types: F.filter(found, lambda s, i: F.array_position(types, s["question_type"]) == i + 1)))
    ordered = F.array_sort(first, lambda a, b: a["start"] - b["start"])

    out = papers.withColumn("_sample", sample).withColumn("_dashed", dashed)
    out = out.withColumn("_found", ordered)
    year = F.nullif(F.regexp_extract("_sample", r"(?:19|20)[0-9]{2}", 0), F.lit("")).cast("int")
    has_c = F.exists("_found", lambda s: s["question_type"] == "C") | F.col("_sample").rlike(rf"(?i)C{V.WS}*型题")
    modern_text = F.col("_sample").rlike(
        rf"(?:136{V.WS}*[-—~～至]{V.WS}*165|共{V.WS}*165{V.WS}*题|满分{V.WS}*300)")
    out = out.withColumn("exam_year", year).withColumn("_has_c", has_c)
    modern = ~F.col("_has_c") & ((F.coalesce("exam_year", F.lit(0)) >= V.MODERN_FROM_YEAR) | modern_text)
    legacy = F.col("_has_c") | (F.size("_found") > 0)
    known = (F.coalesce(F.col("exam_year") == 1994, F.lit(False))
             | (F.col("_has_c") & (F.size("_found") < 3)))
    out = out.withColumn("exam_format", F.when(modern, V.MODERN).when(legacy, V.LEGACY).otherwise(V.UNKNOWN))
    out = out.withColumn(
        "sections",
        F.when(F.col("exam_format") == V.MODERN, sections_literal(V.MODERN_SECTIONS))
        .when((F.col("exam_format") == V.LEGACY) & known, sections_literal(V.LEGACY_1994_SECTIONS))
        .when(F.col("exam_format") == V.LEGACY, F.col("_found").cast(SECTION_TYPE))
        .otherwise(F.array().cast(SECTION_TYPE)))
    return (out
            .withColumn("expected", F.array_max(F.transform("sections", lambda s: s["end"])))
            .withColumn("total_points", F.when(F.col("exam_format") == V.MODERN, F.lit(V.MODERN_TOTAL)))
            .drop("_sample", "_dashed", "_found", "_has_c"))
