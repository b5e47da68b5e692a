"""Comments, likes, reports, moderation, rate limits."""

from pyspark.sql import functions as F

from gradeloom.catalog import Tables, query
from gradeloom.catalog.adapters import K, events
from gradeloom.operators import community, limiter, quota
from gradeloom.session import shared_dir
from gradeloom.sources import tables

TERMS = ["onnthe", "eauque", "xyzzy"]
TERM_SQL = """CASE WHEN strpos(flat, 'onnthe') > 0 THEN 'onnthe' WHEN strpos(flat, 'eauque') > 0 THEN 'eauque' END"""
COMMENTS_SQL = f"""
c0 AS (SELECT conv_id * 10 + turn AS id, (conv_id * 7 + turn) % 150 AS user_id, conv_id % 20 AS question_id,
  role AS nickname, text AS body, conv_id * 10 + turn AS seq, lower(regexp_replace(text, '\\s+', '', 'g')) AS flat FROM conversations),
c1 AS (SELECT *, {TERM_SQL} AS hit FROM c0),
comments AS (SELECT *, CASE WHEN hit IS NULL THEN 'published' ELSE 'pending' END AS status,
  '命中待审核词：' || hit AS moderation_reason FROM c1)"""
MARK_SQL = f"({K} * 10 + event_id % 8)"


def comments(t: Tables):
    base = t.conversations.select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("id"), ((F.col("conv_id") * 7 + F.col("turn")) % 150).alias("user_id"),
        (F.col("conv_id") % 20).alias("question_id"), F.col("role").alias("nickname"), F.col("text").alias("body"),
        (F.col("conv_id") * 10 + F.col("turn")).alias("seq"))
    return community.screen(base, terms=TERMS).withColumn("created_at", F.col("seq"))


def marks(t: Tables, kinds):
    return (events(t).where(F.col("event_type").isin(*kinds))
            .select((F.col("question_id") * 10 + F.col("event_id") % 8).alias("comment_id"), "user_id",
                    F.col("event_id").alias("seq"), "ts", "value"))


@query("top_comments", f"""WITH {COMMENTS_SQL},
likes AS (SELECT {MARK_SQL} AS id, count(DISTINCT user_id) AS likes FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL)
SELECT id, question_id, user_id, status, coalesce(likes, 0) AS likes, user_id = 7 AS own FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq DESC) AS rn FROM comments WHERE status = 'published' OR user_id = 7)
LEFT JOIN likes USING (id) WHERE rn <= 10""")
def top_comments(t: Tables):
    out = community.top_comments(comments(t), marks(t, ["click", "purchase"]), 7, 10)
    return out.select("id", "question_id", "user_id", "status", "likes", "own")


@query("comment_screening", f"WITH {COMMENTS_SQL} SELECT id, status, moderation_reason FROM comments")
def comment_screening(t: Tables):
    return comments(t).select("id", "status", "moderation_reason")


ACTION_SQL = f"""rep AS (SELECT {MARK_SQL} AS comment_id, user_id, event_id + 1000000 AS seq FROM events WHERE event_type IN ('error', 'view')),
act AS (SELECT {MARK_SQL} AS comment_id, CASE WHEN event_id % 3 = 0 THEN 'publish' WHEN event_id % 3 = 1 THEN 'hide' ELSE 'mute' END AS action,
  event_id + 1000000 AS seq FROM events WHERE event_type = 'signup'),
fr AS (SELECT comment_id, seq, row_number() OVER (PARTITION BY comment_id ORDER BY seq) AS rn FROM (
  SELECT comment_id, user_id, min(seq) AS seq FROM rep GROUP BY ALL)),
rp AS (SELECT comment_id, max(seq) AS reported FROM rep WHERE comment_id IN (SELECT comment_id FROM fr WHERE rn = 3) GROUP BY ALL),
ad AS (SELECT comment_id, max(seq) AS acted, arg_max(action, seq) AS action FROM act WHERE action <> 'mute' GROUP BY ALL),
final AS (SELECT c.id, c.user_id, c.seq, CASE WHEN reported IS NOT NULL AND (acted IS NULL OR reported > acted) THEN 'pending'
    WHEN action = 'publish' THEN 'published' WHEN action = 'hide' THEN 'hidden' ELSE c.status END AS status,
  CASE WHEN reported IS NOT NULL THEN '收到 3 次以上举报' ELSE moderation_reason END AS moderation_reason
  FROM comments c LEFT JOIN rp ON rp.comment_id = c.id LEFT JOIN ad ON ad.comment_id = c.id)"""


def _moderation(t: Tables):
    shift = F.col("seq") + 1_000_000
    reports = marks(t, ["error", "view"]).withColumn("seq", shift)
    kind = F.when(F.col("seq") % 3 == 0, "publish").when(F.col("seq") % 3 == 1, "hide").otherwise("mute")
    actions = marks(t, ["signup"]).withColumn("action", kind).withColumn("seq", shift)
    return reports, actions


@query("moderation_status", f"WITH {COMMENTS_SQL}, {ACTION_SQL} SELECT id, status, moderation_reason FROM final")
def moderation_status(t: Tables):
    return community.final_status(comments(t), *_moderation(t)).select("id", "status", "moderation_reason")


@query("moderation_queue", f"""WITH {COMMENTS_SQL}, {ACTION_SQL},
n AS (SELECT comment_id, count(DISTINCT user_id) AS reports FROM rep GROUP BY ALL)
SELECT id, status, coalesce(reports, 0) AS reports FROM (SELECT * FROM final ORDER BY status = 'pending' DESC, seq DESC LIMIT 200)
LEFT JOIN n ON comment_id = id""")
def moderation_queue(t: Tables):
    reports, actions = _moderation(t)
    current = community.final_status(comments(t), reports, actions)
    return community.moderation_queue(current, reports).select("id", "status", "reports")


@query("report_threshold", f"""WITH r AS (SELECT {K} AS comment_id, user_id, min(event_id) AS seq FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT comment_id, seq AS crossed_at, n AS reporters FROM (
  SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY comment_id) AS n FROM r) WHERE rn = 3""")
def report_threshold(t: Tables):
    reports = events(t).where("event_type = 'error'").select(F.col("question_id").alias("comment_id"), "user_id", F.col("event_id").alias("seq"))
    return community.third_reporter(reports).join(community.distinct_reporters(reports), "comment_id").select(
        "comment_id", "crossed_at", "reporters")


MUTE_SQL = """m AS (SELECT user_id, ts, event_id, ts + to_days(least(365, greatest(1, coalesce(nullif((event_id % 11)::INTEGER, 0), 7)))) AS until
  FROM events WHERE event_type = 'error' AND value > 30),
p AS (SELECT user_id, ts, event_id FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""


def _muted(t: Tables):
    ev = events(t)
    mutes = ev.where("event_type = 'error' and value > 30").select(
        "user_id", F.col("event_id").alias("seq"), "ts",
        (F.col("ts") + F.make_dt_interval(community.clamp_days((F.col("event_id") % 11).cast("int")))).alias("muted_until"))
    posts = ev.where("event_type in ('view', 'click', 'purchase')").select(
        "user_id", "ts", F.col("event_id").alias("seq"), "event_type", "value", "question_id")
    return community.muted_as_of(posts, mutes)


@query("mute_asof", f"""WITH {MUTE_SQL}
SELECT p.user_id, p.event_id AS seq, coalesce(arg_max(m.until, struct_pack(t := m.ts, e := m.event_id)) > any_value(p.ts), false) AS muted
FROM p LEFT JOIN m ON m.user_id = p.user_id AND m.ts <= p.ts GROUP BY p.user_id, p.event_id""")
def mute_asof(t: Tables):
    return _muted(t).select("user_id", "seq", "muted")


@query("comment_admission", f"""WITH {MUTE_SQL},
x AS (SELECT p.user_id, p.event_id AS seq, coalesce(arg_max(m.until, struct_pack(t := m.ts, e := m.event_id)) > any_value(p.ts), false) AS muted
  FROM p LEFT JOIN m ON m.user_id = p.user_id AND m.ts <= p.ts GROUP BY p.user_id, p.event_id)
SELECT user_id, seq, CASE WHEN user_id % 20 = 0 THEN 'unknown_user' WHEN muted THEN 'muted' WHEN seq % 10 = 0 THEN 'too_short'
  WHEN seq % 200 > 100 THEN 'too_long' END AS reject_reason, (CASE WHEN seq % 10 = 0 THEN 1 ELSE 3 * (seq % 200) END)::INTEGER AS length FROM x""")
def comment_admission(t: Tables):
    posts = _muted(t).withColumn("body", F.when(F.col("seq") % 10 == 0, "  x ").otherwise(
        F.expr("concat(' ', repeat('abc', cast(seq % 200 as int)), '　')"))).withColumn("question_id", F.col("question_id").cast("string"))
    users = events(t).where("user_id % 20 > 0").select(F.col("user_id").alias("id")).distinct()
    out = community.admit_comments(posts, users)
    return out.select("user_id", "seq", "reject_reason", F.length("body").alias("length"))


@query("audit_log", f"""SELECT {MARK_SQL} AS comment_id, CASE WHEN event_id % 3 = 0 THEN 'publish' WHEN event_id % 3 = 1 THEN 'hide' ELSE 'mute' END AS action,
  CASE WHEN event_id % 3 = 2 THEN coalesce(nullif(value::INTEGER, 0), 7) || ' days' END AS detail, CAST(ts AS DATE) AS action_day
FROM events WHERE event_type = 'signup'""")
def audit_log(t: Tables):
    _, actions = _moderation(t)
    log = community.audit_log(actions.withColumn("days", F.rint("value").cast("int"))).drop("created_at")
    path = shared_dir(t.spark, "audit")
    tables.append_log(log, path, "action_day")
    return t.spark.read.schema(log.schema).parquet(path)


@query("rate_view", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS recent
FROM events""")
def rate_view(t: Tables):
    return quota.request_rate(events(t), ["user_id"], "ts", 3_600_000_000).select("event_id", "recent")


THROTTLE_SQL = """WITH RECURSIVE q AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (
  SELECT user_id, event_id, rn, us, true AS accepted, [us] AS kept FROM q WHERE rn = 1
  UNION ALL
  SELECT q.user_id, q.event_id, q.rn, q.us, len(list_filter(s.kept, lambda x: q.us - x < {w})) < {k},
    CASE WHEN len(list_filter(s.kept, lambda x: q.us - x < {w})) < {k} THEN list_append(list_filter(s.kept, lambda x: q.us - x < {w}), q.us)
         ELSE list_filter(s.kept, lambda x: q.us - x < {w}) END
  FROM s JOIN q ON q.user_id = s.user_id AND q.rn = s.rn + 1)
SELECT user_id, event_id, accepted FROM s"""


@query("throttle_accept", THROTTLE_SQL.format(w=86_400_000_000, k=2))
def throttle_accept(t: Tables):
    """Two requests a day and user; a slice of a user's week is one task's work."""
    return limiter.accepted_requests(events(t), ["user_id"], "ts", "event_id", 2, 86_400_000_000, slice_windows=7).select(
        "user_id", "event_id", "accepted")


@query("debounce_batches", """WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS us,
    lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
y AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM x)
SELECT user_id, min(us) AS first_us, max(us) + 14400000000 AS push_us, count(*) AS changes FROM y GROUP BY user_id, run""")
def debounce_batches(t: Tables):
    return quota.change_batches(events(t), "user_id", "ts", "event_id", 14_400_000_000)


@query("client_keys", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ip' || c_nationkey WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'unknown' END AS client FROM customer""")
def client_keys(t: Tables):
    from gradeloom.functions.text import client_key
    n = F.col("c_custkey") % 3
    xff = F.when(n == 0, F.concat(F.lit(" ip"), "c_nationkey", F.lit(" , proxy"))).when(n == 1, F.lit(" ,proxy"))
    return t.customer.select("c_custkey", client_key(xff, F.when(n == 1, F.col("c_mktsegment")).when(n == 2, F.lit(""))).alias("client"))


@query("author_mutes", f"""WITH {COMMENTS_SQL}
SELECT c.user_id, event_id AS seq, epoch_us(ts) + least(365, greatest(1, coalesce(nullif(value::INTEGER % 400, 0), 7)))::BIGINT * 86400000000 AS until_us
FROM events JOIN comments c ON c.id = {MARK_SQL} WHERE event_type = 'signup' AND event_id % 3 = 2""")
def author_mutes(t: Tables):
    """Mute actions on comments turned into the mute timeline of their authors."""
    _, actions = _moderation(t)
    actions = actions.withColumn("seq", F.col("seq") - 1_000_000).withColumn("days", F.rint("value").cast("int") % 400)
    posted = comments(t).select("id", "user_id")
    return community.mutes_from_actions(actions, posted).select("user_id", "seq", F.unix_micros("muted_until").alias("until_us"))
