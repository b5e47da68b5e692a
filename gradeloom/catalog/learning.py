"""Grading, progress, scores, practice."""

from pyspark.sql import functions as F

from gradeloom.catalog import Tables, query
from gradeloom.catalog.adapters import (ATTEMPTS_SQL, K, RECORDS_SQL, active_banks, attempts, current_results, events, favourites,
                                        questions, records)
from gradeloom.functions.answers import grade, structurally_valid
from gradeloom.operators import learn
from gradeloom.operators.quota import daily_usage, within_daily_quota

BAND_SQL = """CASE WHEN n BETWEEN 1 AND 40 THEN 1.5::DOUBLE WHEN n BETWEEN 41 AND 115 THEN 2.0
  WHEN n BETWEEN 116 AND 135 THEN 1.5 WHEN n BETWEEN 136 AND 165 THEN 2.0 ELSE 0.0 END"""


@query("exam_score", f"""WITH {ATTEMPTS_SQL},
firsts AS (SELECT user_id, question_id, arg_min(outcome, struct_pack(t := ts, i := event_id)) AS first_result
           FROM attempts GROUP BY ALL),
q AS (SELECT p_partkey AS question_id, p_brand AS paper, {BAND_SQL} AS points
      FROM (SELECT *, p_partkey % 165 + 1 AS n FROM part)),
total AS (SELECT paper, sum(points) AS total FROM q GROUP BY paper)
SELECT user_id, paper, sum(CASE WHEN first_result = 'correct' THEN points ELSE 0 END)::DOUBLE AS earned,
       sum(points) AS answered_maximum, any_value(total) AS total
FROM firsts JOIN q USING (question_id) JOIN total USING (paper) GROUP BY user_id, paper""")
def exam_score(t: Tables):
    firsts = learn.first_and_latest(attempts(t), "user_id", "question_id", "outcome", ["ts", "event_id"], "ts")
    paper = learn.with_points(
        questions(t).select("question_id", F.col("bank_id").alias("paper"),
                            (F.col("question_id") % 165 + 1).alias("n")), "n")
    return learn.exam_score(firsts, paper, "user_id", "question_id", "paper").select(
        "user_id", "paper", "earned", "answered_maximum", "total")


@query("first_latest_result", f"""WITH {ATTEMPTS_SQL}
SELECT user_id, question_id, arg_min(outcome, struct_pack(t := ts, i := event_id)) AS first_result,
  arg_max(outcome, struct_pack(t := ts, i := event_id)) AS current_result,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS latest_us, count(*) AS attempts
FROM attempts GROUP BY user_id, question_id""")
def first_latest_result(t: Tables):
    out = learn.first_and_latest(attempts(t), "user_id", "question_id", "outcome", ["ts", "event_id"], "ts")
    return out.select("user_id", "question_id", "first_result", "current_result",
                      F.unix_micros("first_at").alias("first_us"),
                      F.unix_micros("latest_at").alias("latest_us"), "attempts")


@query("progress_stats", f"""WITH {RECORDS_SQL},
n AS (SELECT p_brand AS bank_id, count(*) AS n FROM part GROUP BY ALL)
SELECT user_id, bank_id, count(current_result) AS answered,
  count(*) FILTER (current_result = 'correct') AS correct, count(*) FILTER (current_result = 'wrong') AS wrong,
  CASE WHEN count(current_result) > 0 THEN
    round(count(*) FILTER (current_result = 'correct') * 100.0 / count(current_result)) ELSE 0 END::BIGINT AS accuracy,
  least(100, round(count(current_result) * 100.0 / any_value(n)))::BIGINT AS progress
FROM recs JOIN n USING (bank_id) GROUP BY user_id, bank_id""")
def progress_stats(t: Tables):
    sizes = questions(t).groupBy("bank_id").agg(F.count(F.lit(1)).alias("questions"))
    return learn.progress_stats(records(t), sizes, "user_id", "bank_id")


@query("type_counts", """SELECT p_brand AS bank_id, count(*) FILTER (p_size % 2 = 1) AS single,
  count(*) FILTER (p_size % 2 = 0) AS multiple, count(*) AS "all" FROM part GROUP BY p_brand""")
def type_counts(t: Tables):
    return learn.type_counts(questions(t), "bank_id")


@query("scope_counts", f"""WITH {RECORDS_SQL},
n AS (SELECT p_brand AS active_bank, count(*) AS n FROM part GROUP BY ALL)
SELECT user_id, active_bank, any_value(n) AS "all",
  any_value(n) - count(*) FILTER (bank_id = active_bank AND current_result IS NOT NULL) AS unanswered,
  count(*) FILTER (group_name = active_group AND current_result = 'wrong') AS wrong,
  count(*) FILTER (bank_id = active_bank AND favourite) AS favourite
FROM recs JOIN n USING (active_bank) GROUP BY user_id, active_bank""")
def scope_counts(t: Tables):
    recs = records(t).drop("bank_id", "group_name", "multiple")
    return learn.scope_counts(recs, questions(t), "user_id", "bank_id", "group_name", "question_id")


@query("practice_wrong", f"""WITH {RECORDS_SQL}
SELECT user_id, question_id, group_name FROM recs
WHERE current_result = 'wrong' AND group_name = active_group""")
def practice_wrong(t: Tables):
    recs = records(t).where(F.col("group_name") == F.col("active_group"))
    return learn.practice_pool(recs, "wrong").select("user_id", "question_id", "group_name")


@query("practice_favourite", f"""WITH {RECORDS_SQL}
SELECT user_id, question_id, bank_id FROM recs WHERE favourite AND NOT multiple""")
def practice_favourite(t: Tables):
    return learn.practice_pool(records(t), "favourite", single_only=True).select("user_id", "question_id", "bank_id")


@query("practice_unanswered", f"""WITH {RECORDS_SQL}
SELECT a.user_id, p.p_brand AS bank_id, p.p_partkey AS question_id
FROM active a JOIN part p ON p.p_brand = a.active_bank
WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.user_id = a.user_id AND c.question_id = p.p_partkey)""")
def practice_unanswered(t: Tables):
    enrolled = active_banks(t).select("user_id", F.col("active_bank").alias("bank_id"))
    return learn.unanswered(enrolled, questions(t), current_results(t), "user_id", "bank_id", "question_id").select(
        "user_id", "bank_id", "question_id")


def _bank_marks(t: Tables):
    places = learn.bank_places(questions(t), "bank_id", "question_id", F.floor(F.col("question_id") / 4096))
    enrolled = active_banks(t).select("user_id", F.col("active_bank").alias("bank_id"))
    return enrolled, places, learn.answered_bitmaps(current_results(t), places, "user_id", "bank_id", "question_id")


@query("practice_unanswered_counts", f"""WITH {RECORDS_SQL}
SELECT a.user_id, p.p_brand AS bank_id, count(*) AS questions, count(*) FILTER (NOT EXISTS (SELECT 1 FROM cur c WHERE c.user_id = a.user_id AND c.question_id = p.p_partkey)) AS unanswered
FROM active a JOIN part p ON p.p_brand = a.active_bank GROUP BY ALL""")
def practice_unanswered_counts(t: Tables):
    """Unanswered questions of every learner's bank, counted in bitmaps."""
    return learn.unanswered_counts(*_bank_marks(t), "user_id", "bank_id").select("user_id", "bank_id", "questions", "unanswered")


@query("practice_next_unanswered", f"""WITH {RECORDS_SQL},
u AS (SELECT a.user_id, p.p_brand AS bank_id, p.p_partkey AS question_id FROM active a JOIN part p ON p.p_brand = a.active_bank
  WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.user_id = a.user_id AND c.question_id = p.p_partkey))
SELECT user_id, bank_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY question_id) AS rn FROM u) WHERE rn <= 5""")
def practice_next_unanswered(t: Tables):
    """The next five unanswered questions of every learner, read off the bitmaps."""
    return learn.next_unanswered(*_bank_marks(t), "user_id", "bank_id", "question_id", 5).select("user_id", "bank_id", "question_id")


@query("practice_draw", f"""WITH {RECORDS_SQL},
h AS (SELECT user_id, question_id, md5(concat_ws('|', 'seed-1', user_id, question_id)) AS h FROM recs)
SELECT user_id, question_id, pick FROM (
  SELECT user_id, question_id, row_number() OVER (PARTITION BY user_id ORDER BY h, question_id)::INTEGER AS pick FROM h)
WHERE pick <= 20""")
def practice_draw(t: Tables):
    return learn.draw(records(t).select("user_id", "question_id"), "user_id", "question_id", 20, "seed-1")


@query("practice_draw_bank", f"""WITH {RECORDS_SQL},
en AS (SELECT DISTINCT user_id, active_bank AS bank_id FROM active),
slots AS (SELECT p_brand AS bank_id, p_partkey AS question_id,
  row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws('|', 'seed-1', p_partkey)), p_partkey) AS slot FROM part),
n AS (SELECT p_brand AS bank_id, count(*) AS n FROM part GROUP BY ALL),
w AS (SELECT user_id, bank_id, n, unnest(range(1, least(100, n) + 1)) AS pick,
      ('0x' || substr(md5(concat_ws('|', 'seed-1', user_id)), 1, 12))::BIGINT AS off FROM en JOIN n USING (bank_id))
SELECT user_id, w.bank_id, question_id, pick FROM w JOIN slots s ON s.bank_id = w.bank_id AND s.slot = (off + pick) % n + 1""")
def practice_draw_bank(t: Tables):
    enrolled = active_banks(t).select("user_id", F.col("active_bank").alias("bank_id"))
    return learn.draw_from_bank(enrolled, questions(t), "user_id", "bank_id", "question_id", 100, "seed-1")


@query("auto_favourite", f"""WITH {RECORDS_SQL}
SELECT c.user_id, c.question_id FROM cur c ANTI JOIN fav f ON c.user_id = f.user_id AND c.question_id = f.question_id
WHERE c.current_result = 'wrong'""")
def auto_favourite(t: Tables):
    return learn.wrong_to_favourites(current_results(t), favourites(t), "user_id", "question_id")


@query("reset_impact", f"""WITH {RECORDS_SQL}, noted AS (
  SELECT r.*, CASE WHEN question_id % 3 = 0 THEN 'n' || question_id WHEN question_id % 3 = 1 THEN '  ' END AS note FROM recs r)
SELECT user_id, bank_id, count(current_result) AS answered, count(*) FILTER (current_result = 'wrong') AS wrong,
  count(*) FILTER (favourite) AS favourites, count(*) FILTER (length(trim(coalesce(note, ''))) > 0) AS notes
FROM noted GROUP BY user_id, bank_id""")
def reset_impact(t: Tables):
    kind = F.col("question_id") % 3
    noted = records(t).withColumn("note", F.when(kind == 0, F.concat(F.lit("n"), F.col("question_id"))).when(kind == 1, "  "))
    return learn.reset_impact(noted, "user_id", "bank_id")


# Selections and keys as label sets: bits of an integer, written out as letters.
def _labels(bits):
    return F.filter(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.when(
        F.shiftright(bits.cast("int"), 0).bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0,
        F.substring(F.lit("DCBA"), i + 1, F.lit(1)))), lambda x: x.isNotNull())


SEL = "(event_id % 16)"
KEY_BITS = "(p_partkey % 7)"
GRADE_SQL = """CASE WHEN sel = 0 THEN NULL WHEN kb = 0 THEN 'draft' WHEN sel = kb THEN 'correct' ELSE 'wrong' END"""


@query("grade_attempts", f"""
SELECT outcome, mode, count(*) AS n FROM (
  SELECT {GRADE_SQL} AS outcome, mode FROM (
    SELECT {SEL} AS sel, {KEY_BITS} AS kb, CASE event_type WHEN 'view' THEN 'memorize' WHEN 'signup' THEN 'blind' ELSE 'standard' END AS mode,
           value > 10 AS revealed FROM events JOIN part ON p_partkey = {K})
  WHERE sel > 0 AND mode <> 'memorize' AND (mode <> 'blind' OR revealed)) GROUP BY outcome, mode""")
def grade_attempts(t: Tables):
    """Grading with study modes; selections come in reverse label order."""
    ev = events(t).select(
        "question_id", _labels(F.col("event_id") % 16).alias("selected"),
        F.when(F.col("event_type") == "view", "memorize").when(F.col("event_type") == "signup", "blind")
        .otherwise("standard").alias("mode"), (F.col("value") > 10).alias("revealed"))
    keys = t.part.select(F.col("p_partkey").alias("id"), F.array_sort(_labels(F.col("p_partkey") % 7)).alias("answer"))
    graded = learn.graded_attempts(learn.effective_attempts(ev), keys)
    return graded.groupBy("outcome", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("grade_drafts", f"""WITH d AS (
  SELECT user_id, {K} AS question_id, {SEL} AS sel, row_number() OVER (PARTITION BY user_id, {K} ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type IN ('click', 'view') AND event_id % 16 > 0),
f AS (SELECT DISTINCT user_id, {K} AS question_id FROM events WHERE event_type = 'purchase')
SELECT d.user_id, d.question_id, CASE WHEN sel = kb THEN 'correct' ELSE 'wrong' END AS progress,
  CASE WHEN f.user_id IS NULL THEN CASE WHEN sel = kb THEN 'correct' ELSE 'wrong' END END AS first_progress
FROM d JOIN (SELECT p_partkey, {KEY_BITS} AS kb FROM part) p ON p_partkey = d.question_id
LEFT JOIN f ON f.user_id = d.user_id AND f.question_id = d.question_id WHERE rn = 1 AND kb > 0""")
def grade_drafts(t: Tables):
    """Latest draft selections graded once their keys arrive."""
    from gradeloom.plans.scale import keep_top
    ev = events(t)
    drafts = keep_top(
        ev.where("event_type in ('click', 'view') and event_id % 16 > 0"), ["user_id", "question_id"],
        [F.col("ts").desc(), F.col("event_id").desc()]
    ).select("user_id", "question_id", _labels(F.col("event_id") % 16).alias("selected"))
    patches = t.part.select(F.col("p_partkey").alias("id"), _labels(F.col("p_partkey") % 7).alias("answer"))
    known = ev.where("event_type = 'purchase'")
    return learn.grade_drafts(drafts, patches, known).select("user_id", "question_id", "progress", "first_progress")


@query("regrade_after_correction", f"""WITH s AS (
  SELECT user_id, {K} AS question_id, arg_max({SEL}, struct_pack(t := ts, i := event_id)) AS sel,
    arg_max(CASE event_type WHEN 'purchase' THEN 'correct' ELSE 'wrong' END, struct_pack(t := ts, i := event_id)) AS cur
  FROM events WHERE event_type IN ('purchase', 'click') GROUP BY ALL)
SELECT user_id, question_id, CASE WHEN kb IS NULL OR kb = 0 OR sel = 0 THEN cur WHEN sel = kb THEN 'correct' ELSE 'wrong' END AS current_result
FROM s LEFT JOIN (SELECT p_partkey, {KEY_BITS} AS kb FROM part WHERE p_size > 25) p ON p_partkey = question_id""")
def regrade_after_correction(t: Tables):
    at = F.struct("ts", "event_id")
    latest = attempts(t).groupBy("user_id", "question_id").agg(
        F.max_by(_labels(F.col("event_id") % 16), at).alias("selected"),
        F.max_by("outcome", at).alias("current_result"))
    fixes = t.part.where("p_size > 25").select(F.col("p_partkey").alias("id"), _labels(F.col("p_partkey") % 7).alias("answer"))
    return learn.regrade(latest, fixes).select("user_id", "question_id", "current_result")


@query("daily_quota", """SELECT event_id, user_id, usage_day, used FROM (
  SELECT event_id, user_id, CAST(ts AS DATE) AS usage_day,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)::INTEGER AS used FROM events) WHERE used <= 3""")
def daily_quota(t: Tables):
    return within_daily_quota(events(t), "user_id", "ts", "event_id", 3).select("event_id", "user_id", "usage_day", "used")


@query("daily_usage", """SELECT user_id, CAST(ts AS DATE) AS usage_day, least(count(*), 3) AS request_count,
  greatest(count(*) - 3, 0) AS denied FROM events GROUP BY ALL""")
def usage(t: Tables):
    return daily_usage(events(t), "user_id", "ts", 3)


@query("structural_validity", """SELECT valid, count(*) AS n FROM (
  SELECT length(trim(p_name)) > 0 AND p_size % 5 >= 2 AND p_partkey % 7 > 0
    AND (p_type = 'LARGE' OR bit_count((p_partkey % 7)::INTEGER) = 1)
    AND (p_partkey % 7) & ~((1 << (p_size % 5)) - 1) = 0 AS valid FROM part) GROUP BY valid""")
def structural_validity(t: Tables):
    """Questions whose answer labels all exist; option labels are D, C, B, A in bit order."""
    letters = F.array(*[F.lit(x) for x in "DCBA"])
    options = F.transform(F.slice(letters, F.lit(1), F.col("p_size") % 5),
                          lambda x: F.struct(x.alias("label"), x.alias("text")))
    ok = structurally_valid(F.col("p_name"), options, _labels(F.col("p_partkey") % 7),
                            F.when(F.col("p_type") == "LARGE", "X"))
    return t.part.select(ok.alias("valid")).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("option_shuffle", """SELECT p_partkey AS question_id, string_agg(l, '' ORDER BY md5('seed-1|' || p_partkey || '|' || l)) AS labels
FROM part, (SELECT unnest(['A', 'B', 'C', 'D']) AS l) GROUP BY p_partkey""")
def option_shuffle(t: Tables):
    options = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(x).alias("text")) for x in "ABCD"])
    mixed = learn.shuffle_options(options, F.col("p_partkey"), "seed-1")
    return t.part.select(F.col("p_partkey").alias("question_id"), F.array_join(F.transform(mixed, lambda o: o["label"]), "").alias("labels"))
