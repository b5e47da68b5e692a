"""Search, notes, highlighting, redaction."""

from pyspark.sql import functions as F

from gradeloom.catalog import Tables, query
from gradeloom.functions import text as X
from gradeloom.operators import search
from gradeloom.session import shared_dir


def index(t: Tables, fold=False, part=None):
    q = (t.part if part is None else part).select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("bank_name"), F.col("p_type").alias("group_name"),
        F.concat(F.lit("size "), F.col("p_size")).alias("category"), F.col("p_name").alias("stem"),
        (F.col("p_partkey") % 165).alias("source_number"),
        F.array(F.struct(F.lit("A").alias("label"), F.reverse("p_name").alias("text")),
                F.struct(F.lit("B").alias("label"), F.concat(F.col("p_name"), F.lit(" alt")).alias("text"))).alias("options"))
    return search.search_index(q, unicode_fold=fold)


def _score_sql(term):
    return f"""(CASE WHEN strpos(bn, '{term}') > 0 THEN CASE WHEN bn = '{term}' THEN 220 ELSE 130 END
  WHEN strpos(gn, '{term}') > 0 THEN CASE WHEN gn = '{term}' THEN 150 ELSE 120 END
  WHEN strpos(ca, '{term}') > 0 THEN CASE WHEN ca = '{term}' THEN 125 ELSE 105 END
  WHEN strpos(st, '{term}') > 0 THEN CASE WHEN st = '{term}' THEN 130 WHEN starts_with(st, '{term}') THEN 115 ELSE 95 END
  WHEN nu = '{term}' THEN 80 WHEN strpos(oa, '{term}') > 0 OR strpos(ob, '{term}') > 0 THEN 55 END)"""


BASE_SQL = """b AS (SELECT p_partkey AS id, p_brand AS bank_name, lower(p_brand) AS bn, lower(p_type) AS gn, 'size ' || p_size AS ca, lower(p_name) AS st,
  (p_partkey % 165)::VARCHAR AS nu, reverse(lower(p_name)) AS oa, lower(p_name) || ' alt' AS ob, reverse(p_name) AS ra, p_name || ' alt' AS rb, p_partkey % 165 AS num FROM part)"""


def _search_sql(query_text, terms, limit):
    score = " + ".join(_score_sql(t) for t in terms)
    hit_a = " OR ".join(f"strpos(oa, '{t}') > 0" for t in terms)
    hit_b = " OR ".join(f"strpos(ob, '{t}') > 0" for t in terms)
    return f"""WITH {BASE_SQL}, s AS (SELECT *, {score} + CASE WHEN bn = '{query_text}' THEN 180 WHEN gn = '{query_text}' THEN 120
    WHEN strpos(st, '{query_text}') > 0 THEN 90 WHEN strpos(ca, '{query_text}') > 0 THEN 70 ELSE 0 END AS score,
  CASE WHEN {hit_a} THEN 'A. ' || ra WHEN {hit_b} THEN 'B. ' || rb END AS matched_option FROM b)
SELECT id, score::INTEGER AS score, matched_option FROM s WHERE score IS NOT NULL ORDER BY score DESC, bank_name, num, id LIMIT {limit}"""


@query("search_ranked", _search_sql("red promo 1", ["red", "promo", "1"], 100))
def search_ranked(t: Tables):
    return search.search(index(t), " Red  PROMO 1", 100, collation=None).select("id", "score", "matched_option")


@query("search_stored", _search_sql("red promo 1", ["red", "promo", "1"], 100))
def search_stored(t: Tables):
    """The same search over a stored index: postings of the query's character pairs name the rows to score."""
    root = shared_dir(t.spark, "pairs")
    search.write_index(index(t, part=t.spread("part", 30_000)), root)
    return search.search_stored(t.spark, root, " Red  PROMO 1", 100, collation=None).select("id", "score", "matched_option")


@query("search_stem_phrase", _search_sql("blue bolt", ["blue", "bolt"], 60))
def search_stem_phrase(t: Tables):
    return search.search(index(t), "blue bolt", 60, collation=None).select("id", "score", "matched_option")


ZH_NAMES = ("风", "东", "安", "车", "北")  # an, bei, che, dong, feng in Chinese order


@query("search_zh_order", f"""WITH r AS (SELECT p_partkey AS id, [{', '.join(repr(n) for n in ZH_NAMES)}][p_size % 5 + 1] AS bank_name, [5, 4, 1, 3, 2][p_size % 5 + 1] AS place,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey % 165 END AS num, lower(p_name) AS st FROM part)
SELECT id, bank_name, (CASE WHEN starts_with(st, 'red') THEN 115 ELSE 95 END + CASE WHEN strpos(st, 'red') > 0 THEN 90 ELSE 0 END)::INTEGER AS score FROM r
WHERE strpos(st, 'red') > 0 ORDER BY score DESC, place, num NULLS LAST, id LIMIT 40""")
def search_zh_order(t: Tables):
    """Ranked search with the Unicode fold, bank names in Chinese order, numbers in numeric order and missing ones last."""
    q = t.part.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(n) for n in ZH_NAMES]), F.col("p_size") % 5 + 1).alias("bank_name"),
                      F.lit("g").alias("group_name"), F.lit("c").alias("category"), F.col("p_name").alias("stem"),
                      F.when(F.col("p_size") % 3 == 0, "n").otherwise((F.col("p_partkey") % 165).cast("string")).alias("source_number"),
                      F.array(F.struct(F.lit("A").alias("label"), F.lit("x").alias("text"))).alias("options"))
    return search.search(search.search_index(q), "ＲＥＤ", 40, collation="zh").select("id", "bank_name", "score")


def _fields_sql(term):
    return f"""(CASE WHEN strpos(bn, '{term}') > 0 THEN ['题库'] WHEN strpos(gn, '{term}') > 0 THEN ['分组'] WHEN strpos(ca, '{term}') > 0 THEN ['分类']
  WHEN strpos(st, '{term}') > 0 THEN ['题干'] ELSE list_filter([CASE WHEN strpos(oa, '{term}') > 0 OR strpos(ob, '{term}') > 0 THEN '选项' END,
  CASE WHEN nu = '{term}' THEN '题号' END], lambda x: x IS NOT NULL) END)"""


MANY_SQL = f"""WITH {BASE_SQL},
s AS (SELECT 'one' AS query, id, bank_name, num, {_score_sql('alt')} AS score, {_fields_sql('alt')} AS f FROM b
  UNION ALL SELECT 'two', id, bank_name, num, {_score_sql('64')}, {_fields_sql('64')} FROM b
  UNION ALL SELECT 'three', id, bank_name, num, {_score_sql('size')} + CASE WHEN strpos(ca, 'size') > 0 THEN 70 ELSE 0 END, {_fields_sql('size')} FROM b)
SELECT query, id, score::INTEGER AS score, array_to_string(f, ',') AS fields FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, bank_name, num, id) AS rn FROM s WHERE score IS NOT NULL) WHERE rn <= 50"""
MANY = {"one": "alt", "two": "64", "three": "size"}


@query("search_many", MANY_SQL)
def search_many(t: Tables):
    hits = search.search_many(index(t), MANY, 50)
    return hits.select("query", "id", "score", F.array_join("matched_fields", ",").alias("fields"))


@query("search_many_stored", MANY_SQL)
def search_many_stored(t: Tables):
    root = shared_dir(t.spark, "pairs")
    search.write_index(index(t, part=t.spread("part", 30_000)), root)
    hits = search.search_many_stored(t.spark, root, MANY, 50)
    return hits.select("query", "id", "score", F.array_join("matched_fields", ",").alias("fields"))


@query("search_normal_form", """SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS form FROM documents""")
def search_normal_form(t: Tables):
    """Unicode-folded search form of whole documents."""
    return t.texts().select("doc_id", X.search_form(F.col("text")).alias("form"))


NOTE_SQL = """n AS (SELECT doc_id, source AS stem, text || chr(10) || '> 来源： book ' || (doc_id % 5) || chr(10) || '#' || lang || ' #tag_' || (doc_id % 3) || ' #' || lang AS note FROM documents)"""


def notes(t: Tables):
    note = F.concat(F.col("text"), F.lit("\n> 来源： book "), F.col("doc_id") % 5, F.lit("\n#"), F.col("lang"),
                    F.lit(" #tag_"), F.col("doc_id") % 3, F.lit(" #"), F.col("lang"))
    return t.texts().select("doc_id", F.col("source").alias("stem"), note.alias("note"), F.lit("none").alias("source"))


@query("tag_extract", f"""WITH {NOTE_SQL}
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(note, '#([\\p{{L}}\\p{{N}}_-]{{1,24}})', 1))), ',') AS tags,
  regexp_extract(note, '(?m)^>\\s*来源[：:]\\s*(.+)$', 1) AS source FROM n""")
def tag_extract(t: Tables):
    return notes(t).select("doc_id", F.array_join(F.array_sort(X.note_tags(F.col("note"))), ",").alias("tags"),
                           X.note_source(F.col("note"), F.col("source")).alias("source"))


NOTE_SEARCH_SQL = f"""WITH {NOTE_SQL}
SELECT doc_id FROM n WHERE strpos(lower(stem || ' ' || note), 'book 3') > 0 AND strpos(lower(stem || ' ' || note), 'src1') > 0
  AND strpos(note, '#tag_1') > 0"""


@query("note_search", NOTE_SEARCH_SQL)
def note_search(t: Tables):
    found = search.search_notes(notes(t), "SRC1 book", "tag_1")
    return found.where(F.contains("note", F.lit("book 3"))).select("doc_id")


@query("note_search_stored", NOTE_SEARCH_SQL)
def note_search_stored(t: Tables):
    """The same search over stored notes, whole texts indexed by character pairs."""
    root = shared_dir(t.spark, "notes")
    search.write_note_index(notes(t), root)
    found = search.search_stored_notes(t.spark, root, "SRC1 book", "tag_1")
    return found.where(F.contains("note", F.lit("book 3"))).select("doc_id")


@query("note_summary", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  '# ' || source || chr(10) || text, '(?m)^#{1,6}[ \t]+', '', 'g'), '(?m)^[-*][ \t]+', '', 'g'), '[*_`]', '', 'g'), '\s+', ' ', 'g')) AS summary FROM documents""")
def note_summary(t: Tables):
    md = F.concat(F.lit("# "), F.col("source"), F.lit("\n> 标签：#"), F.col("lang"), F.lit("\n"), F.col("text"))
    return t.texts().select("doc_id", X.note_summary(md).alias("summary"))


@query("note_append", """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '# ' || p_name || chr(10) || chr(10) || '> 来源：' || p_type ELSE 'old #' || p_type END
  || CASE WHEN p_size % 3 = 1 THEN '' ELSE chr(10) || chr(10) || '> 标签：#' || p_type || chr(10) END AS note FROM part WHERE p_size % 3 < 2
UNION ALL SELECT p_partkey, 'old' || chr(10) || chr(10) || '> 标签：#' || p_type || chr(10) FROM part WHERE p_size % 3 = 2""")
def note_append(t: Tables):
    kind = F.col("p_size") % 3
    note = F.when(kind == 0, "  ").when(kind == 1, F.concat(F.lit("old #"), "p_type")).otherwise(" old ")
    return t.part.select(F.col("p_partkey").alias("id"), X.append_tag(
        note, F.concat(F.lit(" ##"), "p_type", F.lit("! ")), F.col("p_name"), F.col("p_type")).alias("note"))


@query("note_block_append", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'n' ELSE base || chr(10) || chr(10) || '## AI 整理 · ' || p_brand || chr(10) || '> 来源：' || p_type ||
  chr(10) || '> 参考框架：第十版 人卫教材（请以教材原文核对）' || chr(10) || chr(10) || p_name || chr(10) END AS note
FROM (SELECT *, CASE WHEN p_size % 4 = 1 THEN '# ' || p_name || chr(10) || chr(10) || '> 来源：' || p_type ELSE 'n' END AS base FROM part)""")
def note_block_append(t: Tables):
    """Appending the same block twice changes nothing the second time."""
    kind = F.col("p_size") % 4
    args = (F.col("p_brand"), F.when(kind == 0, " ").otherwise(F.col("p_name")), F.col("p_name"), F.col("p_type"))
    once = t.part.withColumn("note", X.append_block(F.when(kind == 1, "").otherwise("n"), *args))
    return once.select(F.col("p_partkey").alias("id"), X.append_block(F.col("note"), *args).alias("again"), "note").select(
        "id", F.when(F.trim("again") == F.trim("note"), F.col("note")).alias("note"))


@query("highlight_terms", r"""SELECT doc_id, regexp_replace(text, '(?i)(with|the|an)', '<mark>\1</mark>', 'g') AS marked FROM documents""")
def highlight_terms(t: Tables):
    return t.texts().select("doc_id", X.highlight(F.col("text"), "an THE with the").alias("marked"))


@query("secret_redaction", r"""SELECT doc_id, regexp_replace(regexp_replace(text || ' http://h/?x=1&key=' || doc_id || '&token=t ' || 'sk-' || repeat('a', 9),
  '(?i)([?&](?:key|api_key|token)=)[^&\s]+', '\1[已隐藏]', 'g'), '\b(?:sk|key)-[A-Za-z0-9_-]{8,}\b', '[已隐藏]', 'g') AS redacted FROM documents""")
def secret_redaction(t: Tables):
    raw = F.concat(F.col("text"), F.lit(" http://h/?x=1&key="), F.col("doc_id"), F.lit("&token=t sk-aaaaaaaaa"))
    return t.texts().select("doc_id", X.redact_secrets(raw, None).alias("redacted"))


@query("safe_names", r"""SELECT page_id, substr(regexp_replace(url, '[\\/:*?"<>|]', '-', 'g'), 1, 60) AS file_name, 'Report.' || page_id AS base FROM pages""")
def safe_names(t: Tables):
    return t.pages.select("page_id", X.safe_file_name(F.col("url"), 60, "bank").alias("file_name"),
                          X.base_name(F.concat(F.lit("Report."), F.col("page_id"), F.lit(".PDF"))).alias("base"))
