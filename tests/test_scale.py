"""Helpers against plain windows, limiter against brute force, plan rules."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom import catalog
from gradeloom.functions import privacy
from gradeloom.operators import limiter, quota, reading
from gradeloom.plans import scale

catalog.load()
BATCH = [n for n in catalog.QUERIES if not n.startswith("stream_")]


def rows(spark, n=500):
    rng = random.Random(1)
    # one key holds most rows
    data = [(rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(1000), i, rng.choice([None, *range(50)])) for i in range(n)]
    return spark.createDataFrame(data, "k string, t int, i int, v int")


@pytest.mark.parametrize("before", [False, True])
def test_running_equals_plain_window(spark, before):
    df = rows(spark)
    got = scale.running(df, ["k"], F.floor(F.col("t") / 37), ["t", "i"], {
        "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, before=before)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = (df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0))).withColumn("m", F.max("v").over(w))
            .withColumn("l", F.last("v", True).over(w)))
    cols = ["k", "i", "s", "m", "l"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_bounded_lookback_equals_plain_window(spark):
    df = rows(spark)
    got = scale.bounded_lookback(df, ["k"], F.col("t").cast("bigint"), 50, {"n": F.count(F.lit(1))})
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-49, 0)
    want = df.withColumn("n", F.count(F.lit(1)).over(w))
    assert sorted(map(str, got.select("i", "n").collect())) == sorted(map(str, want.select("i", "n").collect()))


def test_limiter(spark):
    times = [1, 2, 3, 11, 12, 14]
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "k string, s int, i int").withColumn("ts", F.timestamp_micros(F.col("s")))
    out = limiter.accepted_requests(df, ["k"], "ts", "i", 2, 10).where("accepted").orderBy("s").collect()
    assert [r.s for r in out] == [1, 2, 11, 12]


def test_limiter_against_brute_force(spark):
    rng = random.Random(5)
    data = sorted((rng.choice("xyzx"), rng.randrange(400), i) for i in range(300))
    want, kept = {}, {}
    for k, t, i in sorted(data, key=lambda r: (r[1], r[2])):
        recent = [x for x in kept.get(k, []) if t - x < 20]
        want[i] = len(recent) < 3
        kept[k] = recent + [t] * want[i]
    df = spark.createDataFrame(data, "k string, s int, i int").withColumn("ts", F.timestamp_micros(F.col("s")))
    got = {r.i: r.accepted for r in limiter.accepted_requests(df, ["k"], "ts", "i", 3, 20).collect()}
    assert got == want


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("d", 3, 5), ("d", 1, 3), ("d", 7, 8), ("d", 2, 3)], "d string, s int, e int")
    out = reading.merge_intervals(df, ["d"], "s", "e", F.floor(F.col("s") / 4)).orderBy("s").collect()
    assert [(r.s, r.e) for r in out] == [(1, 5), (7, 8)]


def test_pseudonym_is_hmac(spark):
    for key in (b"short", b"k" * 100):
        want = hmac.new(key, "student:AB12".encode(), hashlib.sha256).hexdigest()
        assert spark.range(1).select(privacy.student_pseudonym(key, F.lit(" ab 12 "))).first()[0] == want


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = scale.keep_top(rows(spark), ["k"], [F.col("t"), F.col("i")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_joins(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


#: Shuffles and scans a plan may have at most.
LIMITS = {"top_comments": (4, 3), "moderation_queue": (2, 1), "cascade_erase": (8, 8), "first_result_canonical": (2, 2), "first_result_fold": (1, 1),
          "progress_stats": (3, 5), "scope_counts": (3, 6), "audit_papers": (3, 2), "parse_roundtrip": (4, 2), "parse_inline": (4, 2), "parse_delimited": (2, 2),
          "answer_targets": (0, 1), "bounded_bundles": (0, 1), "group_suggest": (2, 2), "state_upsert": (4, 4), "import_report": (6, 6),
          "highlight_segments": (5, 3), "interval_merge": (4, 2), "throttle_accept": (3, 3)}


@pytest.mark.parametrize("name", list(LIMITS))
def test_shuffles_and_scans_are_bounded(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = sum(plan.count(f"Exchange {kind}") for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition", "RoundRobin"))
    texts = plan.count("REPARTITION_BY_NUM")  # dealing texts to tasks, which the test session asks for
    assert shuffles - texts <= LIMITS[name][0] and plan.count("FileScan") <= LIMITS[name][1]


def test_nine_terms_need_nine_hits(spark):
    from gradeloom.operators import search
    rows = [(str(i), "bank", "g", "c", " ".join("abcdefghi"[:8 + i]), "1", [("A", "x"), ("B", "y")]) for i in range(2)]
    df = spark.createDataFrame(rows, "id string, bank_name string, group_name string, category string, stem string, source_number string, options array<struct<label:string,text:string>>")
    found = search.search(search.search_index(df.withColumn("stem", F.concat(F.lit("zz "), "stem"))), "a b c d e f g h i", collation=None)
    assert [r.id for r in found.select("id").collect()] == ["1"]


def test_numbers_by_range_are_dense_for_any_key(spark):
    rng = random.Random(7)
    data = [("hot", None if rng.random() < 0.9 else rng.randrange(5), i) for i in range(4000)] + [(None, 1, i) for i in range(50)] + [("a", 2, 1)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v int, i int")
    got = {(r.k, r.i): r.n for r in scale.numbered_by_range(df, ["k"], [F.col("v").asc_nulls_last(), F.col("i")], "n").collect()}
    for key in ("hot", None, "a"):
        own = sorted([(v is None, v or 0, i) for k, v, i in data if k == key])
        assert [got[key, i] for _, _, i in own] == list(range(1, len(own) + 1))
