"""Versioned snapshots: merging, late rows, replays, versions and what a read touches."""

import random

from pyspark.sql import functions as F

from gradeloom.streaming import snapshot

SCHEMA = "k string, n bigint"
KEYS, MERGE = ["k"], snapshot.summed(["k"], ["n"])


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_batches_merge_and_replays_change_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    write = snapshot.merge_batch(root, KEYS, MERGE, buckets=4)
    first = spark.createDataFrame([("a", 1), ("b", 2), (None, 5), ("a", 3)], SCHEMA)
    second = spark.createDataFrame([("b", 10), ("c", 1)], SCHEMA)
    write(first, 0)
    write(second, 1)
    want = [("a", 4), ("b", 12), ("c", 1), (None, 5)]
    assert rows(snapshot.read_snapshot(spark, root, SCHEMA)) == want
    files = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    write(second, 1)
    write(first, 0)
    assert rows(snapshot.read_snapshot(spark, root, SCHEMA)) == want and sorted(p.name for p in tmp_path.rglob("*.parquet")) == files
    assert rows(snapshot.read_snapshot(spark, root, SCHEMA, version=0)) == [("a", 4), ("b", 2), (None, 5)]
    assert snapshot.versions(spark, root) == [0, 1]


def test_only_touched_buckets_are_written_and_read(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    write = snapshot.merge_batch(root, KEYS, MERGE, buckets=8)
    write(spark.createDataFrame([(str(i), 1) for i in range(100)], SCHEMA), 0)
    write(spark.createDataFrame([("7", 1)], SCHEMA), 1)
    at = snapshot.manifest(spark, root)
    assert len(at) == 8 and sorted(at.values()) == [0] * 7 + [1]
    assert len(list((tmp_path / "s/data/version=1").glob("bucket=*"))) == 1
    read = snapshot.read_snapshot(spark, root, SCHEMA)
    touched = {b for b, v in at.items() if v == 1}
    assert not any(f"version=0/bucket={b}/" in f for f in read.inputFiles() for b in touched)
    assert dict(rows(read))["7"] == 2 and read.count() == 100


def test_a_batch_that_failed_before_its_manifest_is_written_again(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    write = snapshot.merge_batch(root, KEYS, MERGE, buckets=2)
    write(spark.createDataFrame([("a", 1)], SCHEMA), 0)
    spark.createDataFrame([("a", 99)], SCHEMA).write.parquet(f"{root}/data/version=1/bucket=0")  # left by a lost driver
    write(spark.createDataFrame([("a", 2)], SCHEMA), 1)
    assert rows(snapshot.read_snapshot(spark, root, SCHEMA)) == [("a", 3)]
    write(spark.createDataFrame([], SCHEMA), 2)
    assert rows(snapshot.read_snapshot(spark, root, SCHEMA)) == [("a", 3)] and snapshot.read_snapshot(spark, f"{root}-none", SCHEMA).count() == 0


def test_late_rows_arrive_and_a_stream_resumes(spark, tmp_path):
    root, source = f"file://{tmp_path}/s", f"file://{tmp_path}/in"

    def put(number, data):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{source}/{number}")

    def drained():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        return rows(snapshot.drain_snapshot(stream, root, KEYS, MERGE, buckets=4))
    put(1, [("day2", 1), ("day3", 1)])
    assert drained() == [("day2", 1), ("day3", 1)]
    put(2, [("day1", 1), ("day2", 4)])
    put(3, [("day1", 2)])
    assert drained() == [("day1", 3), ("day2", 5), ("day3", 1)] == drained()


def test_bursts_join_in_any_order(spark):
    merge, gap = snapshot.joined_bursts("k", 10), 10
    rng = random.Random(3)
    times = [(k, rng.randrange(400)) for k in ("a", "b", None) for _ in range(60)]
    want = []
    for key in ("a", "b", None):
        runs = []
        for t in sorted(t for k, t in times if k == key):
            if runs and t - runs[-1][1] < gap:
                runs[-1] = [runs[-1][0], t, runs[-1][2] + 1]
            else:
                runs.append([t, t, 1])
        want += [(key, *r) for r in runs]
    held = None
    for low in range(0, len(times), 45):
        part = spark.createDataFrame([(k, t, t, 1) for k, t in times[low:low + 45]], "k string, first_us bigint, last_us bigint, changes bigint")
        held = merge(part if held is None else held.unionByName(merge(part)))
    assert rows(held.select("k", "first_us", "last_us", "changes")) == sorted(want, key=repr)


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest
    from types import SimpleNamespace

    from gradeloom.session import shared_root

    def session(master, folder=None):
        conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "file:/w"}
        get = lambda key, default=None: conf[key]
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)))
    assert shared_root(session("local[4]")) == "file:/w/_shared"
    assert shared_root(session("spark://h:1", "hdfs://n/c/")) == "hdfs://n/c"
    for master in ("spark://h:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_root(session(master))


def test_first_results_in_any_order(spark, tmp_path):
    """Results and resets arrive late and in several batches; a reset uncovers the first result after it."""
    from gradeloom.streaming import state
    rng = random.Random(11)
    data = [("u", q, rng.choice(["correct", "wrong", None]), seq) for seq in range(60) for q in (1, 2) if rng.random() < 0.6]
    rng.shuffle(data)
    schema, source = "user string, q bigint, value string, seq bigint", f"file://{tmp_path}/in"
    for n in range(0, len(data), 12):
        spark.createDataFrame(data[n:n + 12], schema).coalesce(1).write.parquet(f"{source}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    stamps = stream.selectExpr("1L as user_id", "q as question_id", "value", "seq")
    got = snapshot.drain_updates(state.first_results(stamps), f"file://{tmp_path}/s", ["user_id", "question_id"], buckets=2)
    want = []
    for q in (1, 2):
        own = sorted((s, v) for _, k, v, s in data if k == q)
        reset = max([s for s, v in own if v is None], default=-1)
        after = [(v, s) for s, v in own if s > reset]
        want.append((1, q, *(after[0] if after else (None, reset))))
    assert rows(got) == sorted(want, key=repr)


def test_first_results_merge_without_a_state_per_key(spark, tmp_path):
    """The same from a snapshot, where whole batches are merged; a replayed row changes nothing."""
    from gradeloom.streaming import ledger
    rng = random.Random(12)
    data = [(1, q, rng.choice(["correct", "wrong", None]), seq) for seq in range(40) for q in (1, 2, 3) if rng.random() < 0.6]
    rng.shuffle(data)
    schema, source = "user_id bigint, question_id bigint, value string, seq bigint", f"file://{tmp_path}/in"
    for n in range(0, len(data), 20):
        spark.createDataFrame(data[n:n + 20] + data[:3], schema).coalesce(1).write.parquet(f"{source}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    want = []
    for q in (1, 2, 3):
        own = sorted((s, v) for _, k, v, s in data if k == q)
        reset = max([s for s, v in own if v is None], default=-1)
        after = [(v, s) for s, v in own if s > reset]
        want.append((1, q, *(after[0] if after else (None, reset))))
    assert rows(ledger.drain_firsts(stream, f"file://{tmp_path}/s")) == sorted(want, key=repr)


def test_shares_expire_without_a_timer_per_key(spark, tmp_path):
    """A share seen again in a later batch lives on; those past the newest view are expired, however many batches there were."""
    source = f"file://{tmp_path}/in"
    for n, batch in enumerate([[("a", 10), ("b", 20)], [("a", 90), ("c", 30)], [("b", 5)]]):
        spark.createDataFrame(batch, "token string, expires_ms bigint").coalesce(1).write.parquet(f"{source}/{n}")
    stream = spark.readStream.schema("token string, expires_ms bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    held = snapshot.drain_snapshot(stream, f"file://{tmp_path}/s", ["token"], snapshot.largest(["token"], "expires_ms"), buckets=2)
    assert rows(held) == [("a", 90), ("b", 20), ("c", 30)]
