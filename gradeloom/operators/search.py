"""Ranked multi-field search and note search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.text import first_int, note_source, note_tags, query_form, query_terms, search_form, trim_all
from gradeloom.operators import pair_index

#: Literal queries matched in one scan of the index; more take further scans.
SCAN_QUERIES = 64
FIELDS = ["bank_name", "group_name", "category", "stem", "source_number"]


def search_index(questions: DataFrame, unicode_fold: bool = True) -> DataFrame:
    """Add normalised search columns ``_s_*``; write this once and search it often."""
    out = questions
    for field in FIELDS:
        out = out.withColumn(f"_s_{field}", search_form(F.coalesce(F.col(field).cast("string"), F.lit("")), unicode_fold))
    joined = F.array_join(F.transform("options", lambda o: o["text"]), "\u0001")
    return out.withColumn("_s_options", F.split(search_form(joined, unicode_fold), "\u0001"))


def _term(term: str) -> tuple[Column, Column]:
    """Score of one term (null when it hits nothing) and the names of the fields hit."""
    t = F.lit(term)
    bank, group, category, stem, number = (F.col(f"_s_{f}") for f in FIELDS)
    in_option = F.exists("_s_options", lambda o: F.contains(o, t))
    upper = (F.when(F.contains(bank, t), F.when(bank == t, 220).otherwise(130))
             .when(F.contains(group, t), F.when(group == t, 150).otherwise(120))
             .when(F.contains(category, t), F.when(category == t, 125).otherwise(105))
             .when(F.contains(stem, t), F.when(stem == t, 130).when(F.startswith(stem, t), 115).otherwise(95)))
    score = F.coalesce(upper, F.when(number == t, 80), F.when(in_option, 55))
    main = (F.when(F.contains(bank, t), "题库").when(F.contains(group, t), "分组")
            .when(F.contains(category, t), "分类").when(F.contains(stem, t), "题干"))
    fields = F.when(main.isNotNull(), F.array(main)).otherwise(F.filter(F.array(
        F.when(in_option, "选项"), F.when(number == t, "题号")), lambda x: x.isNotNull()))
    return score, fields


def _match(query: str) -> Column:
    """Struct score / matched_fields / matched_option, null when a term is missing."""
    terms, full = query_terms(query), F.lit(query_form(query))
    if not terms:
        return F.lit(None).cast("struct<score:int,matched_fields:array<string>,matched_option:string>")
    parts = [_term(t) for t in terms]
    bonus = (F.when(F.col("_s_bank_name") == full, V.SEARCH_BONUS["bank"])
             .when(F.col("_s_group_name") == full, V.SEARCH_BONUS["group"])
             .when(F.contains(F.col("_s_stem"), full), V.SEARCH_BONUS["stem"])
             .when(F.contains(F.col("_s_category"), full), V.SEARCH_BONUS["category"]).otherwise(0))
    score = reduce(lambda a, b: a + b, [p[0] for p in parts]) + bonus
    fields = F.array_distinct(F.concat(*[p[1] for p in parts]))
    hits = F.filter(F.arrays_zip(F.col("options").alias("o"), F.col("_s_options").alias("s")),
                    lambda z: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(z["s"], t)))
    option = F.try_element_at(hits, F.lit(1))["o"]
    return F.when(score.isNotNull(), F.struct(
        score.cast("int").alias("score"), fields.alias("matched_fields"),
        F.concat(option["label"], F.lit(". "), option["text"]).alias("matched_option")))


def _ranking(collation: str | None) -> list[Column]:
    name = F.collate("bank_name", collation) if collation else F.col("bank_name")
    return [F.col("score").desc(), name, first_int(F.col("source_number").cast("string")).asc_nulls_last(),
            F.col("source_number")]


def search(index: DataFrame, query: str, limit: int = 100, collation: str | None = "zh",
           tie: str = "id") -> DataFrame:
    """Best ``limit`` questions holding every term of the query."""
    terms = query_terms(query)
    if not terms:
        return index.where(F.lit(False)).withColumn("m", _match(query)).select(*_plain(index), "m.*")
    # Cheap containment test before scoring.
    found = index.where(reduce(lambda a, b: a & b, [F.contains(_blob(), F.lit(t)) for t in terms]))
    scored = found.withColumn("m", _match(query)).where(F.col("m").isNotNull()).select(*_plain(index), "m.*")
    return scored.orderBy(*_ranking(collation), tie).limit(limit)


def search_many(index: DataFrame, queries: dict[str, str], limit: int = 100, tie: str = "id", only: str | None = None) -> DataFrame:
    """Several literal queries, ``SCAN_QUERIES`` to a scan; no join and no pairing of rows with queries.

    ``only`` names a column with the names of the queries that a row is to be matched with.
    """
    from gradeloom.plans.scale import keep_top
    named, parts = list(queries.items()), []

    def match(name: str, query: str) -> Column:
        return F.when(F.array_contains(only, name), _match(query)) if only else _match(query)
    for at in range(0, len(named), SCAN_QUERIES):
        tagged = F.array(*[F.struct(F.lit(name).alias("query"), match(name, q).alias("m")) for name, q in named[at:at + SCAN_QUERIES]])
        parts.append(index.withColumn("h", F.explode(F.filter(tagged, lambda h: h["m"].isNotNull())))
                     .select(*_plain(index), "h.query", "h.m.*"))
    hits = reduce(DataFrame.unionByName, parts)
    return keep_top(hits, ["query"], [*_ranking(None), F.col(tie)], limit)


def write_index(index: DataFrame, root: str) -> None:
    """Store a search index with its character pairs below ``root``."""
    pair_index.build(index, _blob(), root)


def search_stored(spark: SparkSession, root: str, query: str, limit: int = 100, collation: str | None = "zh", tie: str = "id") -> DataFrame:
    """``search`` over a stored index: only rows that hold all character pairs of the query are read and scored."""
    return search(pair_index.candidates(spark, root, {"query": query_terms(query)}).drop("_queries"), query, limit, collation, tie)


def search_many_stored(spark: SparkSession, root: str, queries: dict[str, str], limit: int = 100, tie: str = "id") -> DataFrame:
    """``search_many`` over a stored index; a row is matched with the queries whose pairs it holds."""
    rows = pair_index.candidates(spark, root, {name: query_terms(q) for name, q in queries.items()})
    return search_many(rows, queries, limit, tie, only="_queries").drop("_queries")


def _blob() -> Column:
    return F.concat_ws("\u0001", *[f"_s_{f}" for f in FIELDS], "_s_options")


def _plain(index: DataFrame) -> list[str]:
    return [c for c in index.columns if not c.startswith("_s_")]


def _note_blob(stem: str, note: str, source: str) -> Column:
    return F.lower(F.concat_ws(" ", F.col(stem), note_source(F.col(note), F.col(source)), F.col(note)))


def write_note_index(notes: DataFrame, root: str, stem: str = "stem", note: str = "note", source: str = "source") -> None:
    """Store notes with the character pairs of stem, source and text below ``root``."""
    pair_index.build(notes, _note_blob(stem, note, source), root)


def search_stored_notes(spark: SparkSession, root: str, query: str, tag: str | None = None, stem: str = "stem", note: str = "note",
                        source: str = "source") -> DataFrame:
    """``search_notes`` over stored notes for a query of at least one term."""
    rows = pair_index.candidates(spark, root, {"query": query.lower().split()}).drop("_queries")
    return search_notes(rows, query, tag, stem, note, source)


def search_notes(notes: DataFrame, query: str = "", tag: str | None = None, stem: str = "stem",
                 note: str = "note", source: str = "source") -> DataFrame:
    """Notes holding every term in stem, source or text, and the tag when given."""
    blob = _note_blob(stem, note, source)
    out = notes.where(F.length(trim_all(F.col(note))) > 0)
    for term in query.lower().split():
        out = out.where(F.contains(blob, F.lit(term)))
    return out.where(F.array_contains(note_tags(F.col(note)), tag)) if tag else out
