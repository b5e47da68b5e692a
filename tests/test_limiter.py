"""The parallel limiter against brute force, and the size of its groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import limiter


def plain(times, limit, window):
    kept, out = [], []
    for t in times:
        out.append(sum(x > t - window for x in kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def streams(rng):
    n = rng.randrange(1, 120)
    yield [rng.randrange(300) for _ in range(n)]
    yield list(range(n))  # as regular as can be: no two starts ever meet
    yield [i * rng.choice([1, 2, 5]) for i in range(n)]
    yield [rng.randrange(40) * rng.choice([1, 7]) for _ in range(n)]


def test_slices_pass_on_the_state_that_a_walk_reaches():
    rng = random.Random(0)
    for _ in range(400):
        limit, window, width = rng.choice([1, 2, 3, 5]), rng.choice([3, 10, 17]), rng.choice([1, 2, 4])
        for times in streams(rng):
            times, got, state = np.array(sorted(times)), [], []
            for s in sorted(set((times // (window * width)).tolist())):
                own, begin = times[times // (window * width) == s], s * window * width
                state = [t for t in state if t + window > begin]
                flags, reached = limiter.walk(own, state, limit, window)
                got += flags.tolist()
                state = limiter.passed(state, *limiter.slice_steps(own, begin, limit, window), limit, window)
                assert state == reached
            assert got == plain(times.tolist(), limit, window)


@pytest.mark.parametrize("limit,width", [(1, 1), (3, 2), (2, 64)])
def test_hot_key_by_brute_force(spark, limit, width):
    rng = random.Random(limit)
    data = [("hot", i * 3 % 997, i) for i in range(900)] + [(rng.choice([None, "a", "b"]), rng.randrange(1000), 1000 + i) for i in range(100)]
    df = spark.createDataFrame(data, "k string, s int, i int").withColumn("ts", F.timestamp_micros(F.col("s") - 500)).withColumn("accepted", F.lit("own"))
    got = {r.i: r.accepted for r in limiter.accepted_requests(df, ["k"], "ts", "i", limit, 20, slice_windows=width).collect()}
    want = {}
    for key in (None, "hot", "a", "b"):
        own = sorted((s, i) for k, s, i in data if k == key)
        want |= dict(zip([i for _, i in own], plain([s for s, _ in own], limit, 20)))
    assert got == want


def test_requests_without_time_and_empty_tables(spark):
    df = spark.createDataFrame([("k", 1, 1), ("k", None, 2)], "k string, s int, i int").withColumn("ts", F.timestamp_micros("s"))
    assert {r.i: r.accepted for r in limiter.accepted_requests(df, ["k"], "ts", "i", 1, 10).collect()} == {1: True, 2: None}
    assert limiter.accepted_requests(df.limit(0), ["k"], "ts", "i", 1, 10).count() == 0


def test_a_hot_key_is_spread_over_its_slices(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("_key"), F.floor(F.col("id") / 640).alias("_slice"), F.col("id").alias("_us"))
    states = limiter.entry_states(df, 2, 10, 640).collect()
    assert len(states) == len({r["_slice"] for r in states}) == 32 and all(len(r["_state"]) <= 2 for r in states)
    steps = [len(limiter.slice_steps(np.arange(a, a + 640), a, 2, 10)[0]) for a in (0, 640)]
    assert max(steps) <= 11  # what a key's pass reads of a slice does not grow with the slice


def test_small_groups_share_a_frame():
    """A frame of many groups stays one; a group that goes over frames is whole, and none is lost."""
    import pandas as pd
    frames = [pd.DataFrame({"k": [f"k{i // 5:04d}" for i in range(a, b)], "i": range(a, b)}) for a, b in ((0, 1003), (1003, 1003), (1003, 1004), (1004, 2000))]
    frames.append(pd.DataFrame({"k": ["z"] * 3, "i": [2000, 2001, 2002]}))
    got = list(limiter._groups(iter(frames), ["k"]))
    assert len(got) <= 4 and pd.concat([rows for rows, _ in got])["i"].tolist() == list(range(2003))
    sizes = [high - low for _, bounds in got for low, high in zip(bounds[:-1], bounds[1:])]
    assert sizes == [5] * 400 + [3]
