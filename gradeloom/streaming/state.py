"""Stateful operators: request limiter, report alert, share expiry, first results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeloom.operators.limiter import walk


class Limiter(StatefulProcessor):
    """Sliding-window limiter; state is the last ``limit`` accepted times of a key.

    Rows of one micro-batch are judged in time order; bound the micro-batch at the
    source (files or offsets per trigger) to bound the work per key and trigger.
    """

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.kept.get()
        us, seq = (np.concatenate(c) for c in zip(*((b["us"].to_numpy(), b["seq"].to_numpy()) for b in rows)))
        order = np.lexsort((seq, us))
        accepted, kept = walk(us[order], stored[0] if stored else [], self.limit, self.window_us)
        self.kept.update((kept,))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(order), dtype=object), "seq": seq[order], "accepted": accepted})

    def close(self) -> None:
        pass


def limited_requests(requests: DataFrame, limit: int, window_us: int) -> DataFrame:
    """``key string, us bigint, seq bigint`` to ``key, seq, accepted``."""
    return requests.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, window_us), outputStructType="key string, seq bigint, accepted boolean",
        outputMode="Append", timeMode="None")


class Crossing(StatefulProcessor):
    """Emit a comment once, when its ``threshold``-th distinct reporter arrives."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "users array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.seen.get()
        users = list(stored[0]) if stored else []
        crossed = len(users) >= self.threshold
        for batch in rows:
            for user in batch["user_id"]:
                if len(users) < self.threshold and int(user) not in users:
                    users.append(int(user))
        self.seen.update((users,))
        if not crossed and len(users) >= self.threshold:
            yield pd.DataFrame({"comment_id": [key[0]], "reporters": [self.threshold]})

    def close(self) -> None:
        pass


def report_alerts(reports: DataFrame, threshold: int = 3) -> DataFrame:
    """``comment_id bigint, user_id bigint`` to one alert per comment; state holds ``threshold`` ids."""
    return reports.groupBy("comment_id").transformWithStateInPandas(
        statefulProcessor=Crossing(threshold), outputStructType="comment_id bigint, reporters bigint",
        outputMode="Append", timeMode="None")


class Expiry(StatefulProcessor):
    """Hold a share until its expiry passes the watermark, then emit and forget it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max(int(batch["expires_ms"].max()) for batch in rows)
        stored = self.until.get()
        if stored is None or latest > stored[0]:
            if stored is not None:
                self.handle.deleteTimer(stored[0])
            self.until.update((latest,))
            self.handle.registerTimer(latest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stored = self.until.get()
        self.until.clear()
        at = stored[0] if stored else expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame({"token": pd.Series([key[0]], dtype=object), "expired_ms": [at]})

    def close(self) -> None:
        pass


def expired_shares(shares: DataFrame, ts: str, delay: str = "0 seconds") -> DataFrame:
    """``token string, expires_ms bigint`` and an event time to the shares that expired."""
    return shares.withWatermark(ts, delay).groupBy("token").transformWithStateInPandas(
        statefulProcessor=Expiry(), outputStructType="token string, expired_ms bigint",
        outputMode="Append", timeMode="EventTime")


class FirstResult(StatefulProcessor):
    """Exact reset semantics of the locked first result, by event order.

    A reset that arrives late may uncover any result after it, so results stay, one entry each, until a reset
    passes them.  A batch writes its own entries; the entries are read only when a reset passes the first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.results = handle.getMapState("results", "seq bigint", "value string")
        self.first = handle.getValueState("first", "reset bigint, seq bigint, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reset, first, value = self.first.get() or (-1, None, None)
        new: dict[int, str] = {}
        before = reset
        for batch in rows:
            empty = batch["value"].isna()
            reset = max([reset, *batch["seq"][empty].tolist()])
            new.update(zip(batch["seq"][~empty].tolist(), batch["value"][~empty]))
        new = {seq: v for seq, v in new.items() if seq > reset}
        if reset > before:
            left = {seq: v for (seq,), (v,) in list(self.results.iterator())}
            for seq in [s for s in left if s <= reset]:
                self.results.removeKey((seq,))
                del left[seq]
            if first is not None and first <= reset:
                first = min(left, default=None)
                value = left.get(first)
        for seq, v in new.items():
            self.results.updateValue((seq,), (v,))
        if new and (first is None or min(new) <= first):
            first = min(new)
            value = new[first]
        self.first.update((reset, first, value))
        yield pd.DataFrame({"user_id": [key[0]], "question_id": [key[1]], "value": pd.Series([value], dtype=object),
                            "seq": [reset if first is None else first]})

    def close(self) -> None:
        pass


def first_results(stamps: DataFrame) -> DataFrame:
    """``user_id, question_id bigint, value string, seq bigint`` to the current first result, in update mode."""
    return stamps.groupBy("user_id", "question_id").transformWithStateInPandas(
        statefulProcessor=FirstResult(), outputStructType="user_id bigint, question_id bigint, value string, seq bigint",
        outputMode="Update", timeMode="None")
