"""Ledger merging: golden cases, ties, order independence."""

import itertools
import random

from gradeloom.operators import sync

SCHEMA = "user_id string, question_id string, field string, value string, updated_at bigint, seq bigint"


def led(spark, rows):
    return spark.createDataFrame([("u", *r) for r in rows], SCHEMA)


def merged(spark, rows):
    return {(r.question_id, r.field): (r.value, r.updated_at) for r in sync.merge_ledgers(led(spark, rows)).collect()}


def test_two_devices_and_reset(spark):
    ipad = [("q1", "progress", "wrong", 200, 1), ("q1", "favorite", "true", 200, 1), ("q1", "note", "复盘重点", 200, 1)]
    mac = [("q2", "progress", "correct", 300, 2)]
    rows = {r.question_id: r for r in sync.materialize(sync.merge_ledgers(led(spark, ipad + mac))).collect()}
    assert rows["q1"].progress == "wrong" and rows["q1"].favorite and rows["q1"].note == "复盘重点"
    reset = [("q1", "progress", None, 500, 3), ("q1", "favorite", "false", 500, 3), ("q1", "note", None, 500, 3)]
    after = sync.materialize(sync.merge_ledgers(led(spark, ipad + mac + reset))).collect()
    assert [r.question_id for r in after] == ["q2"]
    both = sync.merge_ledgers(led(spark, ipad + mac))
    assert sync.ledger_diff(both, both).count() == 0
    assert sync.ledger_diff(both, sync.merge_ledgers(led(spark, ipad + mac + reset))).count() == 3


def test_first_result_is_locked(spark):
    rows = [("q", "progress", "wrong", 100, 1), ("q", "firstProgress", "wrong", 100, 1), ("q", "progress", "correct", 200, 2),
            ("q", "progress", "correct", 150, 3), ("q", "firstProgress", "correct", 150, 3)]
    out = merged(spark, rows)
    assert out[("q", "progress")] == ("correct", 200) and out[("q", "firstProgress")] == ("wrong", 100)


def test_ties(spark):
    rows = [("a", "progress", "correct", 5, 1), ("a", "progress", None, 5, 2), ("b", "favorite", "true", 5, 1), ("b", "favorite", "false", 5, 2),
            ("c", "note", "longer", 5, 1), ("c", "note", "short", 5, 2), ("d", "note", "same1", 5, 1), ("d", "note", "same2", 5, 2),
            ("e", "firstProgress", "correct", 5, 1), ("e", "firstProgress", "wrong", 5, 2), ("f", "firstProgress", "wrong", 5, 1), ("f", "firstProgress", None, 5, 2)]
    out = merged(spark, rows)
    assert out[("a", "progress")][0] == "correct" and out[("b", "favorite")][0] == "true"
    assert out[("c", "note")][0] == "longer" and out[("d", "note")][0] == "same2"
    assert out[("e", "firstProgress")][0] == "wrong" and out[("f", "firstProgress")][0] is None


def pairwise_first(left, right):
    if left is None or right is None:
        return left or right
    (lv, lt), (rv, rt) = left, right
    if lv is None or rv is None:
        return left if lt > rt else right if rt > lt else (None, lt)
    return left if lt < rt else right if rt < lt else ("wrong" if "wrong" in (lv, rv) else "correct", lt)


def test_pair_rule_and_canonical_rule(spark):
    values = [(v, t) for v in ("correct", "wrong", None) for t in (1, 2, 3)]
    pairs = list(itertools.product(values, values))
    left = spark.createDataFrame([("u", str(i), "firstProgress", a[0], a[1], 1) for i, (a, _) in enumerate(pairs)], SCHEMA)
    right = spark.createDataFrame([("u", str(i), "firstProgress", b[0], b[1], 2) for i, (_, b) in enumerate(pairs)], SCHEMA)
    want = {str(i): pairwise_first(a, b) for i, (a, b) in enumerate(pairs)}
    got = {r.question_id: (r.value, r.updated_at) for r in sync.merge_pair(left, right).collect()}
    assert got == want
    canonical = {r.question_id: (r.value, r.updated_at) for r in sync.first_result(left.unionByName(right), sync.KEY).collect()}
    assert canonical == want


def test_canonical_rule_ignores_order(spark):
    rng = random.Random(3)
    groups = [[(rng.choice(["correct", "wrong", None]), t) for t in rng.sample(range(20), 5)] for _ in range(60)]

    def run(order):
        rows = [("u", str(i), "firstProgress", *g[j], k) for i, g in enumerate(groups) for k, j in enumerate(order)]
        return {r.question_id: (r.value, r.updated_at) for r in sync.first_result(spark.createDataFrame(rows, SCHEMA), sync.KEY).collect()}

    first = run([0, 1, 2, 3, 4])
    assert first == run([4, 2, 0, 3, 1])
    for i, g in enumerate(groups):
        state = None
        for v in sorted(g, key=lambda x: x[1]):
            state = pairwise_first(state, v)
        assert first[str(i)] == state


def test_bundle_ties(spark):
    local = spark.createDataFrame([("a", "2024", "l"), ("b", "", "l"), ("c", "2024", "l")], "id string, updated_at string, body string")
    remote = spark.createDataFrame([("a", "2024", "r"), ("b", None, "r"), ("c", None, "r"), ("d", None, "r")], "id string, updated_at string, body string")
    keep = {r.id: r.body for r in sync.merge_bundle(local, remote, ["id"], "updated_at", "local").collect()}
    take = {r.id: r.body for r in sync.merge_bundle(local, remote, ["id"], "updated_at", "remote").collect()}
    assert keep == {"a": "l", "b": "r", "c": "l", "d": "r"} and take == {"a": "r", "b": "r", "c": "l", "d": "r"}


def test_records_before_the_first_put_are_kept(spark):
    blank = spark.createDataFrame([], "user_id bigint, part string, key string, value string, updated_at bigint, version bigint")
    puts = spark.createDataFrame([(2, 5, {"notes": "n"})], "user_id bigint, seq bigint, payload map<string,string>")
    led = "user_id bigint, question_id bigint, field string, value string, updated_at bigint, seq bigint"
    early = spark.createDataFrame([(2, 7, "firstProgress", "wrong", 3, 5)], led)
    state = sync.upsert_state(blank, puts.limit(0), early)
    assert [tuple(r) for r in state.collect()] == [(2, "record", "7\u0001firstProgress", "wrong", 3, 0)]
    state = sync.upsert_state(state, puts, early.limit(0))
    assert sorted(tuple(r) for r in state.collect()) == [(2, "payload", "notes", "n", None, 1), (2, "record", "7\u0001firstProgress", "wrong", 3, 1)]
