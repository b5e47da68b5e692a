"""Sliding-window limiter, parallel inside a key.

A request is accepted when fewer than ``limit`` accepted ones lie in the window before it, so every verdict
depends on all earlier ones of its key.  Still, a key's time is cut into slices that are judged apart.

Let ``next(r)`` be the first request a window or more after request r.  The i-th accepted request is

    x(i) = max(x(i - 1) + 1, next(x(i - limit)))

and both terms never fall as their argument grows, so they distribute over the maximum.  With ``a(u)`` for
the requests accepted when the limiter starts empty at request u, and y(1) < ... < y(limit) for the last
accepted requests before a slice that begins with request b, the accepted ones of the slice are

    x(i) = max(a(b)(i), max over j <= i of a(next(y(j)))(i - j + 1))

1. ``slice_steps``: a slice works out, for every request u of its first window at once, how many requests
   ``a(u)`` has in the slice and the last of them.  These are step functions of u; neighbours that
   lead to the same end are one step.
2. ``entry_states``: one pass over a key's steps, slice by slice, tells the state each slice starts with.
3. ``accepted_requests``: slices are judged with their state, stepping from one accepted request to the next.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Windows in a slice.  A slice of one key is one task's work.
SLICE_WINDOWS = 64


def walk(times: np.ndarray, kept: Iterable[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Verdicts of requests in time order, and the last ``limit`` accepted times, from those in ``kept``."""
    accepted, state, i = np.zeros(len(times), bool), deque(kept, maxlen=limit), 0
    while True:
        if len(state) == limit:
            i = max(i, int(np.searchsorted(times, state[0] + window)))
        if i >= len(times):
            return accepted, list(state)
        accepted[i] = True
        state.append(int(times[i]))
        i += 1


def slice_steps(times: np.ndarray, begin: int, limit: int, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(last time of a step's starts, requests accepted, their last ``3 * limit`` times) of every step.

    ``times`` are the requests of a slice that begins at ``begin``, in order.
    """
    n = len(times)
    start = np.unique(times[:np.searchsorted(times, begin + window) + 1], return_index=True)[1]
    follow = np.append(np.searchsorted(times, times + window), n)  # the request n is none
    ring, seen = [start], [start]
    while (ring[-1] < n).any():
        step = np.minimum(ring[-1] + 1, n)
        if len(ring) == limit:
            step = np.maximum(step, follow[ring[0]])
        ring = [*ring[-limit + 1:], step] if limit > 1 else [step]
        seen.append(step)
    grid = np.stack(seen)
    count = (grid < n).sum(axis=0)
    back = count[None, :] - 1 - np.arange(3 * limit)[:, None]
    tail = np.where(back >= 0, times[np.minimum(np.take_along_axis(grid, np.maximum(back, 0), 0), n - 1)], np.iinfo(np.int64).min)
    last = np.append((count[1:] != count[:-1]) | (tail[:, 1:] != tail[:, :-1]).any(axis=0), True)
    return times[start][last], count[last], [t[:c][::-1] for t, c in zip(tail.T[last], count[last])]


def passed(state: list[int], bounds: np.ndarray, counts: np.ndarray, tails: list[np.ndarray], limit: int, window: int) -> list[int]:
    """The state after a slice with these steps, entered with ``state``."""
    paths = [(0, int(counts[0]), tails[0])]  # (shift, accepted, last accepted)
    for j, at in enumerate(state, limit - len(state)):
        step = int(np.searchsorted(bounds, at + window))
        paths.append((j, int(counts[step]), tails[step]) if step < len(bounds) else (j, 0, ()))
    n = min(shift + count for shift, count, _ in paths)
    new = [max(int(tail[i - shift - count - 1]) for shift, count, tail in paths if i > shift) for i in range(max(1, n - limit + 1), n + 1)]
    return [*state, *new][-limit:]


def _bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """First row of every run of equal ``keys``, and the number of rows."""
    change = np.zeros(max(len(frame) - 1, 0), bool)
    for values in (frame[k].to_numpy() for k in keys):
        change |= (values[1:] != values[:-1]).astype(bool)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(frame)]])


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups with the bounds of these; rows of equal ``keys`` must follow each other.

    Many small groups stay one frame, so that a group costs no frame of its own.
    """
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = int(_bounds(frame, keys)[-2])
        if held and not last and all(held[-1][k].iloc[-1] == frame[k].iloc[0] for k in keys):
            held.append(frame)
            continue
        whole = [part for part in (*held, frame.iloc[:last]) if len(part)]
        if whole:
            ready = pd.concat(whole, ignore_index=True)
            yield ready, _bounds(ready, keys)
        held = [frame.iloc[last:]]
    if held:
        ready = pd.concat(held, ignore_index=True)
        yield ready, _bounds(ready, keys)


def entry_states(sliced: DataFrame, limit: int, window_us: int, slice_us: int) -> DataFrame:
    """(_key, _slice, _state): accepted times that a slice starts with, for ``sliced`` rows (_key, _slice, _us)."""
    def steps(frames):
        for rows, bounds in _groups(frames, ["_key", "_slice"]):
            us, at, first = rows["_us"].to_numpy(), rows["_slice"].to_numpy(), bounds[:-1]
            found = [slice_steps(us[low:high], int(at[low]) * slice_us, limit, window_us) for low, high in zip(first, bounds[1:])]
            many = [len(bound) for bound, _, _ in found]
            yield pd.DataFrame({"_key": np.repeat(rows["_key"].to_numpy()[first], many), "_slice": np.repeat(at[first], many),
                                "bound": np.concatenate([f[0] for f in found]), "n": np.concatenate([f[1] for f in found]), "tail": [t for f in found for t in f[2]]})

    def states(frames):
        key, state = None, []
        for rows, bounds in _groups(frames, ["_key", "_slice"]):
            keys, at, out = rows["_key"].to_numpy(), rows["_slice"].to_numpy(), []
            bound, count, tail = (rows[c].to_numpy() for c in ("bound", "n", "tail"))
            for low, high in zip(bounds[:-1], bounds[1:]):
                if keys[low] != key:
                    key, state = keys[low], []
                state = [t for t in state if t + window_us > int(at[low]) * slice_us]
                out.append(state)
                state = passed(state, bound[low:high], count[low:high], tail[low:high], limit, window_us)
            yield pd.DataFrame({"_key": keys[bounds[:-1]], "_slice": at[bounds[:-1]], "_state": out})
    ends = (sliced.select("_key", "_slice", "_us").repartition("_key", "_slice").sortWithinPartitions("_key", "_slice", "_us")
            .mapInPandas(steps, "_key string, _slice bigint, bound bigint, n bigint, tail array<bigint>"))
    return (ends.repartition("_key").sortWithinPartitions("_key", "_slice", "bound")
            .mapInPandas(states, "_key string, _slice bigint, _state array<bigint>"))


def accepted_requests(requests: DataFrame, keys: list[str], ts: str, seq: str, limit: int, window_us: int,
                      slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """``requests`` with ``accepted``: only accepted requests count against the limit.

    Requests of one time go by ``seq``; a request without time has no verdict.
    """
    slice_us = slice_windows * window_us
    names = [c for c in requests.columns if c != "accepted"]
    us = F.unix_micros(ts)
    rows = requests.select(*names).withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).withColumn("_us", us)
    timed = rows.where("_us is not null").withColumn("_slice", F.floor(F.col("_us") / F.lit(slice_us)).cast("bigint"))
    states = entry_states(timed, limit, window_us, slice_us)
    marked = timed.withColumn("_state", F.lit(None).cast("array<bigint>")).unionByName(states, allowMissingColumns=True)

    def judge(frames):
        for group, bounds in _groups(frames, ["_key", "_slice"]):  # the state comes first, since it has no time
            us, known, accepted = group["_us"].fillna(0).to_numpy().astype(np.int64), group["_state"].to_numpy(), np.zeros(len(group), bool)
            for low, high in zip(bounds[:-1], bounds[1:]):
                accepted[low + 1:high] = walk(us[low + 1:high], known[low], limit, window_us)[0]
            yield group.assign(accepted=accepted).drop(index=bounds[:-1])
    schema = StructType([*marked.schema.fields, StructField("accepted", BooleanType())])
    judged = marked.repartition("_key", "_slice").sortWithinPartitions("_key", "_slice", F.col("_us").asc_nulls_first(), seq).mapInPandas(judge, schema)
    return judged.select(*names, "accepted").unionByName(rows.where("_us is null").select(*names, F.lit(None).cast("boolean").alias("accepted")))
