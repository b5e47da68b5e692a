"""Highlights, passages, vocabulary, responses, English papers."""

from pyspark.sql import functions as F

from gradeloom.catalog import Tables, query
from gradeloom.catalog.adapters import K, events
from gradeloom.functions import text as X
from gradeloom.operators import reading

SPANS_SQL = f"""sp AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 60000000)::BIGINT AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS isl FROM m)"""


@query("interval_merge", f"WITH {SPANS_SQL} SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, isl")
def interval_merge(t: Tables):
    start = F.unix_micros("ts")
    spans = events(t).select("user_id", start.alias("s"), (start + F.rint(F.col("value") * 60_000_000).cast("bigint")).alias("e"))
    return reading.merge_intervals(spans, ["user_id"], "s", "e", F.floor(F.col("s") / 86_400_000_000))


MARKS_SQL = """raw AS (SELECT doc_id, (length(text) * (k / 7.0))::INTEGER AS s, (length(text) * (k / 7.0))::INTEGER + 40 * (1 + (doc_id + k)::INTEGER % 3) AS e0, length(text) AS n
  FROM documents, (SELECT unnest(range(1, 6)) AS k) WHERE (doc_id + k) % 2 = 0),
sp AS (SELECT doc_id, s, least(e0, n)::INTEGER AS e FROM raw WHERE s < n),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS isl FROM m),
g AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, isl),
p AS (SELECT doc_id, s, e, true AS highlighted FROM g UNION ALL
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0), s, false FROM g UNION ALL
  SELECT d.doc_id, coalesce(max(e), 0), any_value(length(text)), false FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id)"""


@query("highlight_segments", f"""WITH {MARKS_SQL}
SELECT doc_id, s::BIGINT AS start, e::BIGINT AS "end", highlighted, md5(substr(text, s + 1, e - s)) AS piece FROM p JOIN documents USING (doc_id) WHERE s < e""")
def highlight_segments(t: Tables):
    n = F.length("text")
    base = t.texts().select("doc_id", "text")
    k = F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("k")
    at = F.rint(F.col("n") * (F.col("k") / F.lit(7.0))).cast("int")
    spans = (base.select("doc_id", n.alias("n"), k).where("(doc_id + k) % 2 = 0").withColumn("s", at)
             .withColumn("e", F.least(F.col("s") + 40 * (1 + (F.col("doc_id") + F.col("k")).cast("int") % 3), F.col("n"))).where("s < n"))
    merged = reading.merge_intervals(spans, ["doc_id"], "s", "e", F.floor(F.col("s") / 65_536))
    out = reading.split_segments(base, merged, "doc_id", "text", "s", "e")
    return out.withColumn("piece", F.md5("piece"))


@query("passage_label", """SELECT conv_id, turn, 'Passage ' || chr((65 + greatest(0, c - 1))::INTEGER) AS label FROM (
  SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations)""")
def passage_label(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.col("role").alias("kind"))
    return reading.passage_labels(rows, "conv_id", "turn", "kind", "user").select("conv_id", "turn", "label")


@query("word_count", r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INTEGER AS words,
  len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)?'))::INTEGER AS tokens FROM documents""")
def word_count(t: Tables):
    return t.texts().select("doc_id", X.word_count(F.col("text")).alias("words"), F.size(X.words(F.col("text"))).alias("tokens"))


@query("vocab_lookup", r"""WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)?'))) AS word FROM documents),
n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
d AS (SELECT word, 'item ' || min(item_id) AS meaning FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)?'))) AS word FROM benchmark) GROUP BY word)
SELECT lang, word, n, coalesce(meaning, '待使用自定义 AI 补全释义') AS meaning FROM n LEFT JOIN d USING (word)""")
def vocab_lookup(t: Tables):
    book = t.benchmark.select(F.explode(X.words(F.col("text"))).alias("w"), "item_id").select(
        F.lower("w").alias("word"), F.concat(F.lit("item "), "item_id").alias("meaning"), F.col("item_id").alias("added"))
    return reading.look_up(reading.word_counts(t.texts(), ["lang"], "text"), book).select("lang", "word", "n", "meaning")


@query("blank_tokens", r"""SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') || '|[[' || p_size || ']]|' || p_type || '|[[' || (p_size + 100) || ']]|' AS pieces FROM part""")
def blank_tokens(t: Tables):
    passage = F.concat(F.regexp_replace("p_name", " ", "|"), F.lit("|[["), "p_size", F.lit("]]|"), "p_type", F.lit("|[["), F.col("p_size") + 100, F.lit("]]|"))
    return t.part.select("p_partkey", F.array_join(X.blank_segments(passage), "").alias("pieces"))


RESP_SQL = f"""r AS (SELECT user_id, {K} AS k, {K} // 10 AS section, substr('ABCDE', (event_id % 5)::INTEGER + 1, 1) AS choice, event_type IN ('purchase', 'click') AS submitted, event_id FROM events),
l AS (SELECT user_id, section, k, arg_max(choice, event_id) AS choice, arg_max(submitted, event_id) AS submitted FROM r GROUP BY ALL),
q AS (SELECT p_partkey AS k, CASE WHEN p_size % 7 > 0 THEN substr('ABCDE', p_size % 5 + 1, 1) END AS answer FROM part)"""


def responses(t: Tables):
    r = events(t).select("user_id", F.col("question_id").alias("k"), F.floor(F.col("question_id") / 10).alias("section"),
                         F.substring(F.lit("ABCDE"), (F.col("event_id") % 5).cast("int") + 1, F.lit(1)).alias("choice"),
                         F.col("event_type").isin("purchase", "click").alias("submitted"), "event_id")
    return r.groupBy("user_id", "section", "k").agg(F.max_by("choice", "event_id").alias("choice"), F.max_by("submitted", "event_id").alias("submitted"))


def keys(t: Tables):
    return t.part.select(F.col("p_partkey").alias("k"), "p_brand", F.when(F.col("p_size") % 7 > 0, F.substring(
        F.lit("ABCDE"), F.col("p_size") % 5 + 1, F.lit(1))).alias("answer"))


@query("response_states", f"""WITH {RESP_SQL} SELECT user_id, k, CASE WHEN submitted THEN CASE WHEN answer IS NULL THEN 'unscored' WHEN choice = answer THEN 'correct' ELSE 'wrong' END END AS state
FROM l LEFT JOIN q USING (k)""")
def response_states(t: Tables):
    return responses(t).join(keys(t), "k", "left").select("user_id", "k", reading.response_state(
        F.col("choice"), F.col("submitted"), F.col("answer")).alias("state"))


@query("reused_labels", f"""WITH {RESP_SQL} SELECT user_id, section, choice, count(DISTINCT k) AS blanks FROM l GROUP BY ALL HAVING count(DISTINCT k) > 1""")
def reused_labels(t: Tables):
    return reading.reused_labels(responses(t), ["user_id", "section"], "choice", "k")


@query("answer_orders", """SELECT p_partkey // 100 AS section, string_agg(p_partkey || '-' || CASE WHEN p_size % 7 > 0 THEN substr('ABCDE', p_size % 5 + 1, 1) ELSE '?' END, ' · ' ORDER BY p_partkey) AS answer_order
FROM part GROUP BY ALL""")
def answer_orders(t: Tables):
    return reading.answer_order(keys(t).withColumn("section", F.floor(F.col("k") / 100)), "section", "k", "answer")


@query("test_coverage", """SELECT p_brand, count(DISTINCT p_partkey // 100) AS sections, count(*) AS questions, count(*) FILTER (p_size % 7 > 0) AS answered,
  round(count(*) FILTER (p_size % 7 > 0) * 100.0 / count(*))::BIGINT AS coverage FROM part GROUP BY p_brand""")
def test_coverage(t: Tables):
    return reading.coverage(keys(t).withColumn("section", F.floor(F.col("k") / 100)), "p_brand", "section", "answer")


@query("practice_presence", """SELECT event_id, event_type = 'click' OR value > 10 AS has FROM events""")
def practice_presence(t: Tables):
    r = F.create_map(F.lit("q"), F.struct(F.when(F.col("event_type") == "click", "A").otherwise("").alias("choice"), F.lit(False).alias("submitted")))
    d = F.create_map(F.lit("w"), F.when(F.col("value") > 10, "text").otherwise("  "))
    return events(t).select("event_id", reading.has_practice(r, d).alias("has"))


@query("clear_section", f"""WITH r AS (SELECT DISTINCT user_id, {K} AS k FROM events)
SELECT user_id, count(*) FILTER (k // 10 <> user_id % 10) AS kept FROM r GROUP BY user_id""")
def clear_section(t: Tables):
    """Responses kept after each learner resets one section."""
    from gradeloom.operators.sync import clear_practice
    name = F.concat(F.lit("s"), F.floor(F.col("question_id") / 10), F.lit(":"), "question_id")
    one = events(t).select("user_id", "question_id").distinct().select(
        "user_id", clear_practice(F.create_map(name, F.lit("A")), F.concat(F.lit("s"), F.col("user_id") % 10)).alias("m"))
    return one.groupBy("user_id").agg(F.count_if(F.size("m") > 0).alias("kept"))


@query("note_counters", f"""SELECT p_brand, count(*) FILTER (p_size % 3 = 0) AS notes, count(*) FILTER (p_size % 4 = 0 AND p_size % 5 = 0) AS drafts_pending FROM part GROUP BY p_brand""")
def note_counters(t: Tables):
    none, one = F.array().cast("array<string>"), F.array(F.lit("A"))
    rows = t.part.select("p_brand", F.when(F.col("p_size") % 3 == 0, "n").when(F.col("p_size") % 3 == 1, " ").alias("note"),
                         F.when(F.col("p_size") % 4 == 0, one).otherwise(none).alias("draft_answer"), F.when(F.col("p_size") % 5 == 0, none).otherwise(one).alias("answer"))
    return reading.counters(rows, "p_brand")


@query("companion_wanted", """SELECT p_brand, round(count(*) FILTER (p_size % 4 > 0 AND p_size > 4) * 100.0 / count(*))::BIGINT AS coverage FROM part
GROUP BY p_brand HAVING coverage < 75 AND p_brand NOT LIKE '%3'""")
def companion_wanted(t: Tables):
    q = t.part.select("p_brand", F.lit(1).alias("section"), F.when((F.col("p_size") % 4 > 0) & (F.col("p_size") > 4), "A").alias("answer"))
    covered = reading.coverage(q, "p_brand", "section", "answer")
    return reading.wants_companion(covered, F.endswith("p_brand", F.lit("3"))).select("p_brand", "coverage")
