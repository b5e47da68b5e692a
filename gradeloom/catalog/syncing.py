"""Ledger merging, state documents, bundles, accounts."""

from pyspark.sql import functions as F

from gradeloom.catalog import Tables, query
from gradeloom.catalog.adapters import K, events
from gradeloom.operators import accounts, sync

# Six-hour stamps, so that devices often tie.
STAMP = "(epoch(ts)::BIGINT // 21600)"
LEDGER_SQL = f"""
led AS (
  SELECT user_id, {K} AS question_id, field, val AS value, {STAMP} AS updated_at, event_id AS seq FROM (
    SELECT *, 'progress' AS field, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'wrong' END AS val
    FROM events WHERE event_type IN ('purchase', 'click', 'error')
    UNION ALL SELECT *, 'firstProgress', CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'wrong' END
    FROM events WHERE event_type IN ('purchase', 'click', 'error')
    UNION ALL SELECT *, 'favorite', CASE event_type WHEN 'signup' THEN 'true' ELSE 'false' END
    FROM events WHERE event_type IN ('signup', 'view')
    UNION ALL SELECT *, 'note', CASE WHEN event_type = 'view' THEN 'note ' || value::INTEGER END
    FROM events WHERE event_type IN ('view', 'error')))"""


def ledger(t: Tables):
    # A stamp counts whole seconds, rounded half to even, so the last half second before a boundary lies behind it.
    ev = events(t).withColumn("updated_at", F.expr("cast(rint(unix_micros(ts) / 1000000) as bigint) div 21600"))
    kind = F.col("event_type")
    result = F.when(kind == "purchase", "correct").when(kind == "click", "wrong")
    note = F.when(kind == "view", F.concat(F.lit("note "), F.rint("value").cast("int")))
    graded = kind.isin("purchase", "click", "error")
    fields = F.filter(F.array(*[
        F.struct(F.when(keep, F.lit(name)).alias("field"), value.cast("string").alias("value"))
        for name, keep, value in (
            ("progress", graded, result), ("firstProgress", graded, result),
            ("favorite", kind.isin("signup", "view"), F.when(kind == "signup", "true").otherwise("false")),
            ("note", kind.isin("view", "error"), note))]), lambda f: f["field"].isNotNull())
    return (ev.withColumn("f", F.explode(fields))
            .select("user_id", "question_id", "f.field", "f.value", "updated_at", F.col("event_id").alias("seq")))


LATEST_SQL = """
lww AS (SELECT user_id, question_id, field, value, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, question_id, field ORDER BY updated_at DESC, value IS NOT NULL DESC,
    CASE WHEN field = 'favorite' THEN (value = 'true')::INT WHEN field = 'note' THEN length(value) ELSE 0 END DESC NULLS LAST, seq DESC) AS rn
  FROM led WHERE field <> 'firstProgress') WHERE rn = 1)"""
FIRST_SQL = """
rst AS (SELECT user_id, question_id, max(updated_at) AS r FROM led WHERE field = 'firstProgress' AND value IS NULL GROUP BY ALL),
fst AS (SELECT l.user_id, l.question_id, arg_min(l.value, struct_pack(t := l.updated_at, w := (l.value <> 'wrong')::INT)) AS value, min(l.updated_at) AS updated_at
  FROM led l LEFT JOIN rst USING (user_id, question_id)
  WHERE field = 'firstProgress' AND l.value IS NOT NULL AND (r IS NULL OR l.updated_at > r) GROUP BY ALL),
first_all AS (SELECT coalesce(f.user_id, r.user_id) AS user_id, coalesce(f.question_id, r.question_id) AS question_id,
  f.value, coalesce(f.updated_at, r.r) AS updated_at FROM fst f FULL JOIN rst r ON f.user_id = r.user_id AND f.question_id = r.question_id)"""


@query("ledger_merge", f"WITH {LEDGER_SQL}, {LATEST_SQL} SELECT * FROM lww")
def ledger_merge(t: Tables):
    return sync.merge_latest(ledger(t)).drop("seq")


@query("first_result_canonical", f"WITH {LEDGER_SQL}, {FIRST_SQL} SELECT * FROM first_all")
def first_result_canonical(t: Tables):
    return sync.first_result(ledger(t).where("field = 'firstProgress'"), ["user_id", "question_id"])


FOLD_SQL = """
folded AS (SELECT user_id, question_id, list_reduce(list(struct_pack(v := value, t := updated_at) ORDER BY seq), lambda a, b: struct_pack(
  v := CASE WHEN a.v IS NULL OR b.v IS NULL THEN CASE WHEN a.t > b.t THEN a.v WHEN b.t > a.t THEN b.v END
    WHEN a.t < b.t THEN a.v WHEN b.t < a.t THEN b.v WHEN a.v = 'wrong' THEN a.v ELSE b.v END,
  t := CASE WHEN a.v IS NULL OR b.v IS NULL THEN greatest(a.t, b.t) ELSE least(a.t, b.t) END)) AS r
  FROM led WHERE field = 'firstProgress' GROUP BY ALL)"""


@query("first_result_fold", f"WITH {LEDGER_SQL}, {FOLD_SQL} SELECT user_id, question_id, r.v AS value, r.t AS updated_at FROM folded")
def first_result_fold(t: Tables):
    return sync.fold_first(ledger(t).where("field = 'firstProgress'"), ["user_id", "question_id"])


MERGED_SQL = f"""{LEDGER_SQL}, {LATEST_SQL}, {FIRST_SQL},
merged AS (SELECT * FROM lww UNION ALL SELECT user_id, question_id, 'firstProgress', value, updated_at FROM first_all)"""


@query("ledger_materialize", f"""WITH {MERGED_SQL}
SELECT user_id, question_id, max(value) FILTER (field = 'progress') AS progress,
  max(value) FILTER (field = 'firstProgress') AS first_progress,
  coalesce(bool_or(value = 'true') FILTER (field = 'favorite'), false) AS favorite,
  max(value) FILTER (field = 'note') AS note
FROM merged GROUP BY user_id, question_id HAVING progress IS NOT NULL OR first_progress IS NOT NULL OR favorite OR note IS NOT NULL""")
def ledger_materialize(t: Tables):
    return sync.materialize(sync.merge_ledgers(ledger(t)))


PAIR_SQL = f"""
l0 AS (SELECT * FROM led WHERE seq % 2 = 0), l1 AS (SELECT * FROM led WHERE seq % 2 = 1),
side AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id, field, seq % 2 ORDER BY seq DESC) AS rn FROM led),
a AS (SELECT * FROM side WHERE rn = 1 AND seq % 2 = 0), b AS (SELECT * FROM side WHERE rn = 1 AND seq % 2 = 1)"""


def _sides(t: Tables):
    """The last stamp of each device per field, as two stored ledgers."""
    from gradeloom.plans.scale import keep_top
    led = ledger(t)
    pick = lambda parity: keep_top(
        led.where(F.col("seq") % 2 == parity), sync.KEY, [F.col("seq").desc()])
    return pick(0), pick(1)


@query("ledger_pair_merge", f"""WITH {LEDGER_SQL}, {PAIR_SQL},
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.question_id, b.question_id) AS question_id,
  coalesce(a.field, b.field) AS field, a.seq IS NOT NULL AS hl, b.seq IS NOT NULL AS hr,
  a.value AS lv, b.value AS rv, a.updated_at AS la, b.updated_at AS ra
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.question_id = b.question_id AND a.field = b.field)
SELECT user_id, question_id, field,
  CASE WHEN NOT hl THEN rv WHEN NOT hr THEN lv
    WHEN field = 'firstProgress' AND (lv IS NULL OR rv IS NULL) THEN CASE WHEN la > ra THEN lv WHEN ra > la THEN rv END
    WHEN field = 'firstProgress' THEN CASE WHEN la < ra THEN lv WHEN ra < la THEN rv WHEN lv = 'wrong' THEN lv ELSE rv END
    WHEN la > ra THEN lv WHEN ra > la THEN rv
    WHEN field = 'progress' THEN coalesce(rv, lv)
    WHEN field = 'favorite' THEN CASE WHEN lv = 'true' THEN lv ELSE rv END
    ELSE CASE WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv WHEN length(rv) >= length(lv) THEN rv ELSE lv END END AS value,
  CASE WHEN field = 'firstProgress' AND lv IS NOT NULL AND rv IS NOT NULL THEN least(la, ra) ELSE greatest(la, ra) END AS updated_at
FROM j""")
def ledger_pair_merge(t: Tables):
    return sync.merge_pair(*_sides(t))


@query("ledger_diff", f"""WITH {LEDGER_SQL}, {PAIR_SQL}
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.field, b.field) AS field,
  a.value AS left_value, a.updated_at AS left_at, b.value AS right_value, b.updated_at AS right_at
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.question_id = b.question_id AND a.field = b.field
WHERE a.value IS DISTINCT FROM b.value OR a.updated_at IS DISTINCT FROM b.updated_at OR a.seq IS NULL OR b.seq IS NULL""")
def ledger_diff(t: Tables):
    return sync.ledger_diff(*_sides(t))


@query("ledger_stamp", f"""WITH {LEDGER_SQL},
x AS (SELECT user_id, question_id, field, arg_max(struct_pack(v := value, u := updated_at), seq) AS s FROM led WHERE field <> 'firstProgress' GROUP BY ALL),
r AS (SELECT user_id, question_id, max(seq) AS r, arg_max(updated_at, seq) AS ru FROM led WHERE field = 'firstProgress' AND value IS NULL GROUP BY ALL),
f AS (SELECT l.user_id, l.question_id, arg_min(struct_pack(v := l.value, u := l.updated_at), l.seq) AS s FROM led l LEFT JOIN r USING (user_id, question_id)
  WHERE field = 'firstProgress' AND value IS NOT NULL AND (r IS NULL OR seq > r) GROUP BY ALL)
SELECT user_id, question_id, field, s.v AS value, s.u AS updated_at FROM x
UNION ALL SELECT coalesce(f.user_id, r.user_id), coalesce(f.question_id, r.question_id), 'firstProgress', f.s.v, coalesce(f.s.u, r.ru)
FROM f FULL JOIN r ON f.user_id = r.user_id AND f.question_id = r.question_id""")
def ledger_stamp(t: Tables):
    return sync.stamp_ledger(ledger(t))


@query("ledger_normalize", f"""WITH e AS (SELECT event_id, user_id, {K} AS k, event_type, value FROM events),
n AS (
  SELECT user_id, event_id AS seq, 'q' || k AS question_id, 'progress' AS field,
    CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN NULL ELSE 'wrong' END AS value,
    CASE event_type WHEN 'purchase' THEN event_id WHEN 'error' THEN event_id ELSE 1 END AS updated_at FROM e
  UNION ALL SELECT user_id, event_id, 'q' || k, 'firstProgress', 'wrong', 1 FROM e
  UNION ALL SELECT user_id, event_id, 'q' || k, 'favorite', CASE WHEN event_type = 'click' THEN 'false' ELSE 'true' END,
    CASE WHEN event_type = 'click' THEN event_id ELSE 1 END FROM e
  UNION ALL SELECT user_id, event_id, 'q' || k, 'note', 'kept ' || k, 1 FROM e WHERE event_type <> 'view'
  UNION ALL SELECT user_id, event_id, 'q' || k, 'note', NULL, 1 FROM e WHERE event_type = 'view')
SELECT * FROM n""")
def ledger_normalize(t: Tables):
    """States with mixed valid, invalid and legacy records."""
    kind, q = F.col("event_type"), F.concat(F.lit("q"), F.col("question_id"))
    prog = (F.when(kind == "purchase", F.concat(F.lit('{"value":"correct","updatedAt":'), F.col("event_id"), F.lit("}")))
            .when(kind == "error", F.concat(F.lit('{"value":null,"updatedAt":'), F.col("event_id"), F.lit("}")))
            .when(kind == "click", F.lit('{"value":"maybe","updatedAt":7}')).otherwise(F.lit('{"updatedAt":7}')))
    fav = (F.when(kind == "click", F.concat(F.lit('{"value":false,"updatedAt":'), F.col("event_id"), F.lit("}")))
           .otherwise(F.lit('{"value":"true","updatedAt":9}')))
    note = F.when(kind == "view", F.lit('{"value":null,"updatedAt":-5}')).otherwise(F.lit('{"value":12}'))
    payload = F.concat(F.lit('{"recordLedger":{"'), q, F.lit('":{"progress":'), prog, F.lit(',"favorite":'), fav,
                       F.lit(',"note":'), note, F.lit(',"other":{"value":1}},"":{"progress":{"value":"wrong"}}},"progress":{"'), q,
                       F.lit('":"wrong","zz":"perhaps"},"favorites":["'), q, F.lit('"],"notes":{"'), q, F.lit('":"kept '),
                       F.col("question_id"), F.lit('"}}'))
    states = events(t).select("user_id", F.col("event_id").alias("seq"), payload.alias("payload"))
    return sync.normalize_ledger(states).select("user_id", "seq", "question_id", "field", "value", "updated_at")


@query("bank_reset", f"""WITH {LEDGER_SQL}, {PAIR_SQL},
resets AS (SELECT user_id, p_brand AS bank_id, max(event_id) AS reset_at FROM events JOIN part ON p_partkey = {K}
  WHERE event_type = 'error' AND value > 40 GROUP BY ALL),
hit AS (SELECT user_id, p_partkey AS question_id, max(reset_at) AS updated_at FROM resets JOIN part ON p_brand = bank_id GROUP BY ALL)
SELECT user_id, question_id, field, value, updated_at FROM a ANTI JOIN hit USING (user_id, question_id)
UNION ALL SELECT user_id, question_id, f.field, f.value, updated_at FROM hit,
  (VALUES ('progress', NULL), ('firstProgress', NULL), ('favorite', 'false'), ('note', NULL)) f(field, value)""")
def bank_reset(t: Tables):
    from gradeloom.catalog.adapters import questions
    qs = questions(t).select("question_id", "bank_id")
    resets = (events(t).where("event_type = 'error' and value > 40").join(qs, "question_id")
              .groupBy("user_id", "bank_id").agg(F.max("event_id").alias("reset_at")))
    return sync.reset_bank(_sides(t)[0], qs, resets)


@query("bank_reset_read", f"""WITH {LEDGER_SQL}, {PAIR_SQL},
resets AS (SELECT user_id, p_brand AS bank_id, max(event_id) // 60 AS reset_at FROM events JOIN part ON p_partkey = {K}
  WHERE event_type = 'error' AND value > 40 GROUP BY ALL)
SELECT a.user_id, a.question_id, field, a.value, updated_at FROM a LEFT JOIN part ON p_partkey = question_id LEFT JOIN resets r ON r.user_id = a.user_id AND bank_id = p_brand
WHERE reset_at IS NULL OR updated_at > reset_at OR (updated_at = reset_at AND field <> 'firstProgress' AND a.value IS NOT NULL)""")
def bank_reset_read(t: Tables):
    """The ledger after bank resets that are kept as one row per learner and bank; stamps and resets share one clock of six hours."""
    from gradeloom.catalog.adapters import questions
    qs = questions(t).select("question_id", "bank_id")
    resets = (events(t).where("event_type = 'error' and value > 40").join(qs, "question_id")
              .select("user_id", "bank_id", F.col("event_id").alias("reset_at")))
    stones = sync.bank_tombstones(resets).withColumn("reset_at", F.floor(F.col("reset_at") / 60))
    return sync.read_after_resets(_sides(t)[0], qs, stones)


@query("payload_overlay", """WITH p AS (
  SELECT user_id, event_id AS seq, unnest([event_type, 'settings', 'unknown']) AS k0, unnest([props, value::INTEGER::VARCHAR, 'x']) AS v FROM events),
m AS (SELECT user_id, seq, CASE k0 WHEN 'purchase' THEN 'progress' WHEN 'click' THEN 'notes' WHEN 'view' THEN 'nickname' ELSE k0 END AS key, v FROM p)
SELECT user_id, key, arg_max(v, seq) AS value, any_value(n) AS version FROM m
JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) USING (user_id)
WHERE key IN ('progress', 'notes', 'nickname', 'settings') GROUP BY user_id, key""")
def payload_overlay(t: Tables):
    """Latest value of every allowed state key and the state version."""
    puts = _puts(t)
    return sync.overlay_puts(puts).join(sync.versions(puts), "user_id").select("user_id", "key", "value", "version")


def _puts(t: Tables):
    kind = F.col("event_type")
    key = F.when(kind == "purchase", "progress").when(kind == "click", "notes").when(kind == "view", "nickname").otherwise(kind)
    return t.events.select("user_id", F.col("event_id").alias("seq"), F.create_map(
        key, F.col("props"), F.lit("settings"), F.rint("value").cast("int").cast("string"), F.lit("unknown"), F.lit("x")).alias("payload"))


@query("state_upsert", f"""WITH {MERGED_SQL}, p AS (
  SELECT user_id, event_id AS seq, unnest([event_type, 'settings', 'unknown']) AS k0, unnest([props, value::INTEGER::VARCHAR, 'x']) AS v FROM events),
m AS (SELECT user_id, seq, CASE k0 WHEN 'purchase' THEN 'progress' WHEN 'click' THEN 'notes' WHEN 'view' THEN 'nickname' ELSE k0 END AS key, v FROM p),
rows AS (SELECT user_id, 'payload' AS part, key, arg_max(v, seq) AS value, NULL::BIGINT AS updated_at FROM m
  WHERE key IN ('progress', 'notes', 'nickname', 'settings') GROUP BY user_id, key
  UNION ALL SELECT user_id, 'record', question_id || chr(1) || field, value, updated_at FROM merged)
SELECT rows.*, n AS version FROM rows JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) USING (user_id)""")
def state_upsert(t: Tables):
    """Two series of puts applied one after the other; the second starts from the state the first wrote.

    All first results come with the first series, since the two-way rule for them depends on what was merged before.
    """
    led, puts = ledger(t), _puts(t)
    first = F.col("seq") < 3000
    blank = t.spark.createDataFrame([], "user_id bigint, part string, key string, value string, updated_at bigint, version bigint")
    state = sync.upsert_state(blank, puts.where(first), led.where(first | (F.col("field") == "firstProgress")))
    return sync.upsert_state(state, puts.where(~first), led.where(~first & (F.col("field") != "firstProgress")))


BUNDLE_SQL = """
loc AS (SELECT user_id, {k} AS item, max(value::INTEGER) AS u, arg_max(event_id, struct_pack(v := value::INTEGER, e := event_id)) AS content FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
rem AS (SELECT user_id, {k} AS item, max(value::INTEGER) AS u, arg_max(event_id, struct_pack(v := value::INTEGER, e := event_id)) AS content FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
ls AS (SELECT user_id, item, CASE WHEN u % 9 = 0 THEN '' ELSE printf('%06d', u) END AS updated_at, content FROM loc),
rs AS (SELECT user_id, item, CASE WHEN u % 7 = 0 THEN NULL ELSE printf('%06d', u) END AS updated_at, content FROM rem)
""".format(k=K)


def _bundles(t: Tables):
    ev = t.events.select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item"),
                         F.rint("value").cast("int").alias("u"), "event_id")
    def side(parity, mod, empty):
        g = ev.where(F.col("event_id") % 2 == parity).groupBy("user_id", "item").agg(
            F.max("u").alias("u"), F.max_by("event_id", F.struct("u", "event_id")).alias("content"))
        return g.select("user_id", "item", F.when(F.col("u") % mod == 0, F.lit(empty).cast("string"))
                        .otherwise(F.format_string("%06d", "u")).alias("updated_at"), "content")
    return side(0, 9, ""), side(1, 7, None)


for _tie, _op in (("local", ">="), ("remote", ">")):
    @query(f"bundle_merge_tie_{_tie}", f"""WITH {BUNDLE_SQL},
j AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.item, r.item) AS item, l.user_id IS NOT NULL AS hl, r.user_id IS NOT NULL AS hr,
  coalesce(l.updated_at, '') AS la, coalesce(r.updated_at, '') AS ra, l.updated_at AS lu, r.updated_at AS ru, l.content AS lc, r.content AS rc
  FROM ls l FULL JOIN rs r ON l.user_id = r.user_id AND l.item = r.item),
d AS (SELECT *, hr AND NOT (hl AND la <> '' AND (ra = '' OR la {_op} ra)) AS taken FROM j)
SELECT user_id, item, CASE WHEN taken THEN ru ELSE lu END AS updated_at, CASE WHEN taken THEN rc ELSE lc END AS content, taken FROM d""")
    def _bundle(t: Tables, tie=_tie):
        return sync.merge_bundle(*_bundles(t), ["user_id", "item"], "updated_at", tie)


@query("bounded_bundles", f"""WITH b AS (SELECT user_id, event_id, 'bank-' || repeat('x', ({K} * 2)::INTEGER) AS id, value::INTEGER AS questions FROM events)
SELECT user_id, event_id, length(id)::INTEGER AS id_length, questions, CASE WHEN length(id) > 160 THEN 'long_id' WHEN questions IS NULL OR questions < 1 THEN 'no_questions'
  WHEN questions > 25000 THEN 'too_many_questions' END AS reject_reason FROM b""")
def bounded_bundles(t: Tables):
    banks = events(t).select("user_id", "event_id", F.rint("value").cast("int").alias("questions"),
                             F.concat(F.lit("bank-"), F.expr("repeat('x', cast(question_id * 2 as int))")).alias("id"))
    return sync.admit_banks(banks, "user_id", "event_id").select("user_id", "event_id", F.length("id").alias("id_length"), "questions", "reject_reason")


@query("upsert_users", """WITH c AS (
  SELECT user_id, event_id, ts, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE 'u' || user_id || '@' || event_id END AS email,
    'nick' || (event_id % 13) AS nickname FROM events)
SELECT user_id AS id, arg_max(email, event_id) FILTER (nullif(email, '') IS NOT NULL) AS email, arg_max(nickname, event_id) AS nickname,
  epoch_us(max(ts)) AS last_seen_us FROM c GROUP BY user_id""")
def upsert_users(t: Tables):
    n = F.col("event_id")
    logins = events(t).select(
        F.col("user_id").alias("id"), n.alias("seq"), "ts", F.concat(F.lit("nick"), n % 13).alias("nickname"),
        F.when(n % 5 == 0, "").when(n % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("user_id"), F.lit("@"), n)).alias("email"))
    return accounts.upsert_users(logins).select("id", "email", "nickname", F.unix_micros("last_seen_at").alias("last_seen_us"))


@query("patch_details", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS name,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS group_name FROM part""")
def patch_details(t: Tables):
    """Missing patch columns keep the old value; an empty string replaces it."""
    old = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("group_name"))
    patches = t.part.select(F.col("p_partkey").alias("id"),
                            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("new "), "p_name")).alias("name"),
                            F.when(F.col("p_partkey") % 4 == 0, F.lit("")).alias("group_name"))
    return accounts.patch_details(old, patches, "id", ["name", "group_name"])


@query("cascade_erase", """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
go AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'users' AS table_name, (SELECT count(*) FROM gone) AS erased
UNION ALL SELECT 'comments', (SELECT count(*) FROM go)
UNION ALL SELECT 'comment_likes', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM go) OR l_suppkey IN (SELECT c_custkey FROM gone))""")
def cascade_erase(t: Tables):
    return accounts.erased_counts(*_erasure(t))


def _erasure(t: Tables):
    """Customers as users, their orders as comments, line items as likes by suppliers; users in debt are gone."""
    users = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal")
    gone = users.where("c_acctbal < 0").select(F.col("id").alias("user_id"))
    comments = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    likes = t.lineitem.select(F.col("l_orderkey").alias("comment_id"), F.col("l_suppkey").alias("user_id"))
    return {"users": users.drop("c_acctbal"), "comments": comments, "comment_likes": likes}, gone


@query("cascade_rest", """SELECT l_orderkey AS comment_id, l_suppkey AS user_id, count(*) AS likes FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
  AND l_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL""")
def cascade_rest(t: Tables):
    """Likes that remain after the users, their comments and the likes on those are gone."""
    t.size_by("lineitem")
    tables, gone = _erasure(t)
    return accounts.erase_users(tables, gone)["comment_likes"].groupBy("comment_id", "user_id").agg(F.count(F.lit(1)).alias("likes"))


@query("owner_delete", """SELECT o_orderkey AS id, o_custkey AS user_id FROM orders
ANTI JOIN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') d ON d.l_orderkey = o_orderkey AND d.l_suppkey = o_custkey""")
def owner_delete(t: Tables):
    comments = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    wanted = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("user_id"))
    return accounts.owner_delete(comments, wanted)


@query("unexpired_shares", """SELECT o_orderkey AS id, epoch_us(o_orderdate + INTERVAL 7 DAY) AS expires_us FROM orders
WHERE o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1998-01-01' AND length(md5(o_orderkey::VARCHAR)) BETWEEN 32 AND 64""")
def unexpired_shares(t: Tables):
    shares = t.orders.select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("token"),
                             (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return accounts.live_shares(shares, F.lit("1998-01-01").cast("timestamp")).select(
        "id", F.unix_micros("expires_at").alias("expires_us"))


def _hmac_sql(message):
    import hashlib
    key = KEY.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


KEY = b"example key for tests"


@query("pseudonyms", f"""SELECT c_custkey, valid, {_hmac_sql("'student:' || sid")} AS pseudonym FROM (
  SELECT c_custkey, sid, regexp_full_match(sid, '[A-Z0-9_-]{{4,32}}') AS valid FROM (
    SELECT c_custkey, upper(replace('s ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '#' ELSE '-a' END, ' ', '')) AS sid FROM customer))""")
def pseudonyms(t: Tables):
    from gradeloom.functions import privacy
    raw = F.concat(F.lit(" s "), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "#").otherwise("-a "))
    return t.customer.select("c_custkey", privacy.valid_student_id(privacy.normal_student_id(raw)).alias("valid"),
                             privacy.student_pseudonym(KEY, raw).alias("pseudonym"))


@query("masked_emails", """SELECT c_custkey, substr(m, 1, 2) || '•••@' || c_mktsegment AS masked
FROM (SELECT *, replace(c_name, '#', '.') AS m FROM customer)""")
def masked_emails(t: Tables):
    from gradeloom.functions.privacy import mask_email
    email = F.concat(F.translate("c_name", "#", "."), F.lit("@"), F.col("c_mktsegment"))
    return t.customer.select("c_custkey", mask_email(email).alias("masked"))
