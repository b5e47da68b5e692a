"""Bank library, grouping, orders."""

from pyspark.sql import functions as F

from gradeloom.catalog import Tables, query
from gradeloom.catalog.adapters import K, events
from gradeloom.operators import library
from gradeloom.operators.accounts import rename, replace_content


@query("bank_rollup", """WITH a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT p_type AS group_name, p_brand AS bank_id, GROUPING(p_type, p_brand)::INTEGER AS level, count(*) AS questions,
  count(*) FILTER (p_size % 2 = 1) AS single, count(*) FILTER (p_size % 2 = 0) AS multiple,
  count(*) FILTER (p_retailprice::BIGINT % 3 = 0) AS pending, count(a.n) AS completed,
  round(count(a.n) * 100.0 / count(*))::BIGINT AS completion
FROM part LEFT JOIN a ON l_partkey = p_partkey GROUP BY GROUPING SETS ((p_type, p_brand), (p_type), ())""")
def bank_rollup(t: Tables):
    answered = t.lineitem.where("l_returnflag <> 'N'").select("l_partkey").distinct().withColumn("completed", F.lit(True))
    q = (t.part.join(answered, F.col("l_partkey") == F.col("p_partkey"), "left")
         .select(F.col("p_type").alias("group_name"), F.col("p_brand").alias("bank_id"),
                 (F.col("p_size") % 2 == 0).alias("multiple"), (F.rint("p_retailprice").cast("bigint") % 3 == 0).alias("pending"),
                 F.coalesce("completed", F.lit(False)).alias("completed")))
    return library.bank_rollup(q, "group_name", "bank_id")


RULE_SQL = """CASE WHEN regexp_matches(b, '(?:西医综合|西综|(?:^|[^0-9])306(?:[^0-9]|$))') THEN '考研西综306'
  WHEN regexp_matches(b, '(?i)影像|放射|CT|MRI|超声') THEN '医学影像学' ELSE '' END"""


@query("group_suggest", f"""WITH h AS (SELECT p_brand, string_agg(p_type || ' ' || p_name, chr(10) ORDER BY p_partkey) AS q FROM part GROUP BY ALL)
SELECT p_brand AS bank_id, {RULE_SQL} AS suggested_group FROM (SELECT p_brand, n || chr(10) || q AS b FROM h
  JOIN (SELECT DISTINCT p_brand, CASE WHEN p_brand LIKE '%1' THEN 'exam 306 ' WHEN p_brand LIKE '%2' THEN 'a1306 ' ELSE '' END || p_brand AS n FROM part) USING (p_brand))""")
def group_suggest(t: Tables):
    brand = F.col("p_brand")
    banks = t.part.select(F.col("p_brand").alias("bank_id"), F.concat(
        F.when(F.endswith(brand, F.lit("1")), "exam 306 ").when(F.endswith(brand, F.lit("2")), "a1306 ").otherwise(""), brand).alias("name")).distinct()
    qs = t.part.select(F.col("p_brand").alias("bank_id"), F.col("p_partkey").alias("pos"), "p_type", "p_name")
    return library.suggest_groups(banks, qs, "bank_id", "name", "pos", "p_type", "p_name").select("bank_id", "suggested_group")


@query("bank_normalize", """SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN '未命名题库' ELSE p_name END AS name,
  repeat(p_name || ' x', 300) AS description,
  CASE WHEN p_size % 3 = 0 THEN 'auto' WHEN p_size % 3 = 1 THEN '' ELSE p_type || ' ' || p_brand END AS group_name, p_size = 7 AS featured
FROM part""")
def bank_normalize(t: Tables):
    size = F.col("p_size")
    banks = t.part.select(
        F.col("p_partkey").alias("id"), F.when(size < 10, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("　"))).alias("name"),
        F.expr("repeat(concat(p_name, ' x'), 300)").alias("description"),
        F.when(size % 3 == 1, "").when(size % 3 == 2, F.concat(F.lit(" "), "p_type", F.lit("\t  "), "p_brand")).alias("group_name"),
        F.when(size == 7, True).alias("featured"), F.lit("auto").alias("suggested"))
    return library.normalize_banks(banks, "suggested").drop("suggested")


@query("question_normalize", """SELECT p_partkey AS pos, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE 'id' || p_partkey END, ''), p_brand || ':' || p_partkey) AS id,
  CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'A,B' END AS answer, p_type = 'LARGE' OR p_size % 3 > 0 AS multiple FROM part""")
def question_normalize(t: Tables):
    qs = t.part.select(
        F.col("p_brand").alias("bank_id"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("id"), "p_partkey")).alias("id"),
        F.when(F.col("p_type") == "LARGE", "X").alias("question_type"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a"), F.lit("A"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("A"))).alias("answer"))
    return library.normalize_questions(qs).select("pos", "id", F.array_join("answer", ",").alias("answer"), "multiple")


@query("group_order", f"""WITH have AS (SELECT DISTINCT user_id, CASE WHEN p_type = 'SMALL' THEN '未分组题库' ELSE p_type END AS group_name
  FROM events JOIN part ON p_partkey = {K} WHERE event_type = 'view'),
saved AS (SELECT user_id, CASE WHEN p_type = 'SMALL' THEN '未分组题库' ELSE p_type END AS group_name, min(event_id) AS s
  FROM events JOIN part ON p_partkey = {K} WHERE event_type = 'click' AND value < 8 GROUP BY ALL)
SELECT user_id, group_name, row_number() OVER (PARTITION BY user_id ORDER BY s NULLS LAST, group_name = '未分组题库', group_name)::INTEGER AS position
FROM have LEFT JOIN saved USING (user_id, group_name)""")
def group_order(t: Tables):
    ev = events(t).join(t.part.select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("g")), "question_id")
    name = F.when(F.col("g") == "SMALL", "").otherwise(F.col("g"))
    banks = ev.where("event_type = 'view'").select("user_id", name.alias("group_name"))
    from gradeloom.fixed import UNGROUPED
    saved = ev.where("event_type = 'click' and value < 8").select(
        "user_id", F.when(name == "", UNGROUPED).otherwise(name).alias("group_name"), F.col("event_id").alias("position"))
    return library.group_positions(saved, banks, "user_id")


@query("group_moves", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['a','b','c','d'] ELSE ['d','c','b','a'] END AS l,
  substr('abcd', (o_custkey % 4)::INTEGER + 1, 1) AS nm, substr('abcd', (o_orderkey // 3 % 4)::INTEGER + 1, 1) AS tg FROM orders),
p AS (SELECT *, list_position(l, nm)::INTEGER AS i, list_position(l, tg)::INTEGER AS j, list_filter(l, lambda x: x <> nm) AS rest FROM o)
SELECT o_orderkey, array_to_string(CASE WHEN i = 4 THEN l ELSE l[1:i-1] || [l[i+1], nm] || l[i+2:] END, ',') AS moved,
  array_to_string(CASE WHEN nm = tg THEN l ELSE rest[1:j-1] || [nm] || rest[j:] END, ',') AS dropped FROM p""")
def group_moves(t: Tables):
    letters = F.lit("abcd")
    base = F.array(*[F.lit(x) for x in "abcd"])
    o = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, base).otherwise(F.reverse(base)).alias("l"),
        F.substring(letters, (F.col("o_custkey") % 4).cast("int") + 1, F.lit(1)).alias("nm"),
        F.substring(letters, (F.floor(F.col("o_orderkey") / 3) % 4).cast("int") + 1, F.lit(1)).alias("tg"))
    return o.select("o_orderkey", F.array_join(library.move_by(F.col("l"), F.col("nm"), 1), ",").alias("moved"),
                    F.array_join(library.drop_at(F.col("l"), F.col("nm"), F.col("tg")), ",").alias("dropped"))


@query("group_order_normalize", """SELECT o_orderkey, array_to_string(list_distinct_keep, ',') AS names FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = p THEN [p] ELSE [o_orderstatus, p] END AS list_distinct_keep FROM (
    SELECT o_orderkey, o_orderstatus, o_orderpriority AS p FROM orders))""")
def group_order_normalize(t: Tables):
    raw = F.array(F.concat(F.lit(" "), "o_orderstatus"), F.lit("  "), F.col("o_orderpriority"),
                  F.regexp_replace("o_orderpriority", " ", "  \t"), F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", F.array_join(library.normalize_group_order(raw), ",").alias("names"))


@query("current_bank_first", """SELECT p_partkey AS id, p_name || '*' AS name, 0 AS priority FROM part WHERE p_size = 3
UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_size <> 3""")
def current_bank_first(t: Tables):
    saved = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    current = t.part.where("p_size = 3").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("*")).alias("name"))
    return library.with_current_first(saved, current)


@query("nested_banks", """SELECT p_brand AS bank_id, (p_partkey // 500)::INTEGER AS part, count(*)::INTEGER AS n,
  string_agg(p_name, ',' ORDER BY p_partkey) AS stems FROM part GROUP BY ALL""")
def nested_banks(t: Tables):
    qs = t.part.select(F.col("p_brand").alias("bank_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("stem"))
    nested = library.nest_questions(qs, "bank_id", "pos", ["stem"], 500)
    return nested.select("bank_id", "part", F.size("questions").alias("n"),
                         F.array_join(F.transform("questions", lambda q: q["stem"]), ",").alias("stems"))


@query("page_listing", """SELECT conv_id, 0 AS part, string_agg('[[PAGE ' || (turn + 1) || ']]' || chr(10) || text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def page_listing(t: Tables):
    pages = t.conversations.select("conv_id", "turn", F.concat(F.lit("[[PAGE "), F.col("turn") + 1, F.lit("]]\n"), F.col("text")).alias("body"))
    return library.listing(pages, ["conv_id"], "turn", "body")


@query("companion_files", """SELECT l_orderkey AS batch, max(f) FILTER (NOT a) AS source_file, max(f) FILTER (a) AS answer_file FROM (
  SELECT l_orderkey, 'file-' || l_linenumber || '-' || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN '-Answer' ELSE '' END || '.pdf' AS f, l_linenumber % 3 = 0 AS a FROM lineitem)
GROUP BY l_orderkey HAVING count(*) = 2 AND count(*) FILTER (a) = 1""")
def companion_files(t: Tables):
    files = t.lineitem.select(F.col("l_orderkey").alias("batch"), F.concat(
        F.lit("file-"), "l_linenumber", F.lit("-"), "l_partkey", F.when(F.col("l_linenumber") % 3 == 0, "-Answer").otherwise(""), F.lit(".pdf")).alias("name"))
    return library.pair_companions(files, "batch", "name")


@query("featured_banks", """SELECT p_partkey AS id, p_retailprice AS updated_at FROM part WHERE p_size = 9""")
def featured_banks(t: Tables):
    banks = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") == 9).alias("featured"), F.col("p_retailprice").alias("updated_at"))
    return library.featured(banks).select("id", "updated_at")


@query("stage_counts", "SELECT lang AS stage, count(*) AS tests FROM documents WHERE lang <> 'en' GROUP BY lang")
def stage_counts(t: Tables):
    return library.stage_counts(t.documents.select("doc_id", F.col("lang").alias("stage")), "en")[1]


@query("test_replace_rename", """SELECT p_partkey AS id, p_size AS imported_at, CASE WHEN p_partkey % 5 = 0 THEN 'v2 ' || p_type ELSE p_type END AS content,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || repeat('y', 200) END AS name FROM part""")
def test_replace_rename(t: Tables):
    old = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("imported_at"), F.col("p_type").alias("content"), F.col("p_name").alias("name"))
    new = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id"), F.lit(0).alias("imported_at"), F.concat(F.lit("v2 "), "p_type").alias("content"), F.col("p_name").alias("name"))
    swapped = replace_content(old, new, "id", ["imported_at"])
    asked = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(
        F.expr("concat(' ', p_brand, repeat('y', 200))")).alias("wanted"))
    return swapped.join(asked, "id").select("id", "imported_at", "content", rename(F.col("wanted"), F.col("name")).alias("name"))


@query("distinct_labels", """SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part""")
def distinct_labels(t: Tables):
    return library.distinct_values(t.part.select(F.split("p_name", " ").alias("tags")), "tags", "tag")


@query("library_listing", """SELECT o_orderkey AS id, epoch_us(o_orderdate::TIMESTAMP) AS imported_us FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 120""")
def library_listing(t: Tables):
    """First page of a library, newest import first."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("imported_at"))
    return library.newest_first(rows, page=120).select("id", F.unix_micros(F.col("imported_at").cast("timestamp")).alias("imported_us"))
