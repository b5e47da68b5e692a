"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words (their 64-bit hashes), patterns are the windows of the test items.  For
patterns of one length m a table over blocks of two words holds how far the search may move
on; blocks that no pattern holds let it skip m - 1 words.  Where the shift is zero, the hash
of the pattern's last block selects a bucket of patterns and their bytes are compared.
Cursors run over all texts of a piece at once, long texts being cut into lanes that overlap.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has
no window and is never found; an item of fewer words than the window is one shorter window;
items with equal windows are all reported; repeated rows each get their row; extra columns
stay. Windows of items with a
null id count as hits, but the items are not listed.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.frames import U, Texts, WORD_BYTES, free_name, map_pieces, mix, written

WINDOW = 10
#: Most windows searched in one pass; this bounds what is broadcast (about 200 bytes each).
PASS_WINDOWS = 250_000
LANE = 512


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0xD6E8FEB86659FD93) + b)


class Group:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]]):
        self.length = length
        self.texts = sorted(patterns)
        self.items = [patterns[p] for p in self.texts]
        words = Texts(pa.array([p.decode("utf-8", "surrogateescape") for p in self.texts])).words(WORD_BYTES)
        grid = words.hashes.reshape(len(self.texts), length)
        self.width = min(2, length)
        self.bits = U(max(12, int(4 * len(self.texts) * length).bit_length()))
        self.shift = np.full(1 << int(self.bits), length - self.width + 1, np.int32)
        for end in range(self.width - 1, length):  # later ends give smaller shifts
            np.minimum.at(self.shift, self.slot(grid, end), length - 1 - end)
        suffix = self.suffix(grid, length - 1)
        order = np.argsort(suffix, kind="stable")
        self.keys, first = np.unique(suffix[order], return_index=True)
        self.buckets = np.split(order, first[1:])

    def suffix(self, grid: np.ndarray, end: int) -> np.ndarray:
        return _block(grid[..., end - 1], grid[..., end]) if self.width == 2 else mix(grid[..., end])

    def slot(self, grid: np.ndarray, end: int) -> np.ndarray:
        return (self.suffix(grid, end) >> (U(64) - self.bits)).astype(np.int64)

    def find(self, words) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        h, m = words.hashes, self.length
        low, high = words.first[:-1] + m - 1, words.first[1:]
        lanes = np.maximum(0, -(-(high - low) // LANE))
        start = np.repeat(low, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + LANE, np.repeat(high, lanes))
        found = []
        while len(start):
            last = _block(h[start - 1], h[start]) if self.width == 2 else mix(h[start])
            step = self.shift[(last >> (U(64) - self.bits)).astype(np.int64)]
            zero = np.flatnonzero(step == 0)
            if len(zero):
                at = np.searchsorted(self.keys, last[zero])
                at[at == len(self.keys)] = 0
                for j in np.flatnonzero(self.keys[at] == last[zero]):
                    first = int(start[zero[j]]) - m + 1
                    here = b" ".join(words.data[words.starts[i]:words.ends[i]].tobytes() for i in range(first, first + m))
                    found += [(first, int(p)) for p in self.buckets[at[j]] if self.texts[p] == here]
            start = start + np.maximum(step, 1)
            alive = start < stop
            start, stop = start[alive], stop[alive]
        return found


def windows_of(items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, length, window): the windows of every item, words lower-cased and joined by one space."""
    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = piece.column("item").to_pylist(), []
        words = Texts(piece.column("text")).words(WORD_BYTES, lower=True)
        for i in range(piece.num_rows):
            w = [words.data[words.starts[k]:words.ends[k]].tobytes() for k in range(words.first[i], words.first[i + 1])]
            size = min(window, len(w))
            out += [(ids[i], size, b" ".join(w[k:k + size])) for k in range(len(w) - size + 1) if size]
        return pa.RecordBatch.from_arrays(
            [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.binary()))], ["item", "length", "window"])
    plain = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return map_pieces(plain, cut, "item string, length int, window binary").distinct()


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_text: str = "text",
               item_id: str = "item_id", pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``hit_spans``.

    ``hit_spans`` lists the runs of hit words as (first word, word after the last).  Test windows are
    searched in passes of at most ``pass_windows`` (whole windows, in hash order), each broadcast; a
    pass carries the rows on with what it found, so no join back to the documents is needed.
    """
    spark = docs.sparkSession
    table = written(windows_of(items, window, item_text, item_id)
                    .withColumn("slot", F.xxhash64("window")), "windows")
    total = table.select("window").distinct().count()
    passes = max(1, -(-total // pass_windows))
    found = free_name(docs.columns, "found")
    out = docs.withColumn(found, F.lit(None).cast("struct<words:bigint,runs:array<array<int>>,items:array<string>>"))
    for k in range(passes):
        by_length: dict[int, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for r in table.where(F.pmod("slot", F.lit(passes)) == k).collect():  # about pass_windows rows
            named = by_length[r.length][bytes(r.window)]
            if r.item is not None:  # windows of items without an id are hits of no listed item
                named.append(r.item)
        handle = spark.sparkContext.broadcast({n: dict(p) for n, p in by_length.items()})
        out = _one_pass(out, handle, f"{uuid.uuid4()}", text, found)
        if k + 1 < passes:
            out = written(out, "pass")
    runs, held = F.col(f"`{found}`.runs"), F.col(f"`{found}`.items")
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    fresh = {"n_words": F.col(f"`{found}`.words"), "n_hit": hit, "n_items": F.size(held).cast("long"),
             "items_sha256": F.sha2(F.array_join(F.array_sort(held), ","), 256), "contaminated": hit > 0, "hit_spans": runs}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in fresh]
    return out.select(*kept, *[v.alias(c) for c, v in fresh.items()])


#: The tables of the broadcast in use, built once per worker process.
_TABLES: dict[str, list[Group]] = {}


def _groups(handle, key: str) -> list[Group]:
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = [Group(n, p) for n, p in sorted(handle.value.items())]
    return _TABLES[key]


def _one_pass(df: DataFrame, handle, key: str, text: str, found: str) -> DataFrame:
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = Texts(piece.column(text)).words(WORD_BYTES, lower=True)
        runs: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        for group in _groups(handle, key):
            for first, pattern in group.find(words):
                d = int(words.text[first])
                at = first - int(words.first[d])
                runs[d].append([at, at + group.length])
                items[d].update(group.items[pattern])
        values = [{"words": int(words.counts[d]), "runs": _merge([*((b or {}).get("runs") or []), *runs.get(d, [])]),
                   "items": sorted({*((b or {}).get("items") or []), *items.get(d, ())})}
                  for d, b in enumerate(piece.column(found).to_pylist())]
        at = piece.schema.get_field_index(found)
        return piece.set_column(at, piece.schema.field(at), pa.array(values, piece.schema.field(at).type))
    return map_pieces(df, run, df.schema, text)


def _merge(runs: list) -> list:
    out: list = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out
