"""Quality rules: gradient-boosted trees over document statistics.

Statistics are computed for whole texts in array form.  Trees are grown on histograms by a small
trainer over a bounded sample of labelled rows, with monotonic constraints: more repetition, more
repeated lines or more symbols never raise a score.  The forest is flattened into node arrays
(feature, threshold, value; children of node i are 2 i + 1 and 2 i + 2) and scored for all texts of
a piece at once.

Defined results: null and empty texts have zero statistics and fail the base rules; lines are cut
at U+000A only; equal rows get equal results; without labelled rows of both kinds the forest is
empty and every text that passes the base rules is kept; missing ids or labels are passed over;
extra columns stay.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from gradeloom.llm.deobfuscate import sample_labels
from gradeloom.llm.frames import NOT_SPACE, U, Texts, map_pieces, mix

TRAIN_ROWS = 30_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees read, with the direction a rise may move the score (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "capital_rate": 0, "digit_rate": 0,
            "mark_rate": 0, "distinct_rate": 0, "short_rate": 0, "line_length": 0, "bar_rate": -1}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT, _UPPER, _BAR = _table(b"#*$%&|<>"), _table(b"0123456789"), _table(bytes(range(65, 91))), _table(b"|")
_ALPHA, _MARK = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])), _table(b"!?.,;:'\"()[]{}-_/\\=+~^`@")
_LINE = np.ones(256, bool)
_LINE[10] = False
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first bytes of code points


def statistics(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(texts x counts, texts x features)."""
    def per_text(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[texts.data])])
        return sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]

    words = texts.words(NOT_SPACE)
    n = words.counts.astype(np.int64)
    spaces = np.concatenate([[0], np.cumsum(NOT_SPACE[texts.data])])
    lines = texts.words(_LINE)
    worded = spaces[lines.ends] > spaces[lines.starts]
    line_key = mix(lines.hashes[worded] + mix(lines.text[worded].astype(U) + U(1)))
    _, first = np.unique(line_key, return_index=True)
    owner = lines.text[worded]
    n_lines = np.bincount(owner, minlength=texts.size)
    dup = n_lines - np.bincount(owner[first], minlength=texts.size)

    at, h = words.windows(5)
    key = mix(h + mix(words.text[at].astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        equal = key[order][1:] == key[order][:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    repeat = covered[words.first[1:]] - covered[words.first[:-1]]
    _, first = np.unique(mix(words.hashes + mix(words.text.astype(U) + U(1))), return_index=True)
    distinct = np.bincount(words.text[first], minlength=texts.size)
    short = np.bincount(words.text[words.ends - words.starts <= 3], minlength=texts.size)

    chars = per_text(NOT_SPACE & _HEAD)
    symbols = per_text(_SYMBOL)
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    features = np.stack([np.log1p(n), chars / w, symbols / w, dup / np.maximum(n_lines, 1), repeat / w, per_text(_UPPER) / np.maximum(per_text(_ALPHA), 1),
                         per_text(_DIGIT) / c, per_text(_MARK) / w, distinct / w, short / w, n / np.maximum(n_lines, 1), per_text(_BAR) / w], axis=1)
    return np.stack([n, chars, symbols, dup, repeat], axis=1), features


@dataclasses.dataclass
class Forest:
    """Node arrays of all trees: (trees, nodes); leaves have an infinite threshold above them."""

    bias: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += value[node]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0,
         least_rows: int = 5) -> Forest:
    """Boosted trees for the logistic loss.

    A split on a constrained feature is taken only if its two leaf values are in order, and both
    sides are then held to their own side of the middle, so that deeper splits keep the order.
    """
    nodes, n_features = 2 ** (depth + 1) - 1, x.shape[1]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    forest = Forest(float(np.log(share / (1 - share))), depth, np.zeros((trees, nodes), int), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    z = np.full(len(x), forest.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        where = np.zeros(len(x), int)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            if node not in bounds:
                continue
            low, high = bounds[node]
            rows = np.flatnonzero(where == node)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            own = float(np.clip(total_g / (total_h + ridge), low, high))
            forest.value[t, node] = own * rate
            best = None
            if node < 2 ** depth - 1 and len(rows) >= 2 * least_rows:
                for j in range(n_features):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, j], minlength=size))[:-1]
                    left = np.clip(gl / (hl + ridge), low, high)
                    right = np.clip((total_g - gl) / (total_h - hl + ridge), low, high)
                    gain = gl ** 2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g ** 2 / (total_h + ridge)
                    fine = (nl >= least_rows) & (len(rows) - nl >= least_rows) & (signs[j] * (right - left) >= 0)
                    if fine.any():
                        k = int(np.where(fine, gain, -np.inf).argmax())
                        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k, left[k], right[k])
            if best is None:  # all rows go left, to a leaf of the same value
                if node < 2 ** depth - 1:
                    bounds[2 * node + 1] = (own, own)
                    where[rows] = 2 * node + 1
                continue
            _, j, k, left_value, right_value = best
            forest.feature[t, node], forest.threshold[t, node] = j, edges[j][k]
            goes_right = binned[rows, j] > k
            where[rows] = 2 * node + 1 + goes_right
            middle = (left_value + right_value) / 2
            sides = ((low, high), (low, high)) if not signs[j] else ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
            bounds[2 * node + 1], bounds[2 * node + 2] = sides
        z += forest.value[t, where]
    return forest


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, **options) -> Forest:
    """A forest from at most ``rows`` labelled texts; only their statistics come to the driver."""
    known = docs.select("doc_id", "text").join(sample_labels(labels, label, rows), "doc_id").select("text", "y")

    def read(piece: pa.RecordBatch) -> pa.RecordBatch:
        _, x = statistics(Texts(piece.column("text")))
        return pa.RecordBatch.from_arrays([piece.column("y").cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])
    seen = map_pieces(known, read, "y int, x array<double>").toPandas()
    y = seen["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Forest(0.0, 0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    order = np.lexsort(np.array(seen["x"].tolist()).T)  # the same forest whatever the order of rows
    return grow(np.array(seen["x"].tolist())[order], y[order], list(FEATURES.values()), **options)


def judge(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with the counts and ``quality`` (chance of label 1)."""
    handle = docs.sparkSession.sparkContext.broadcast(forest)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*COUNTS, "quality")])

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts, x = statistics(Texts(piece.column(text)))
        return pa.RecordBatch.from_arrays([*piece.columns, *[pa.array(counts[:, j], pa.int64()) for j in range(len(COUNTS))], pa.array(handle.value.score(x))],
                                          [*piece.schema.names, *COUNTS, "quality"])
    schema = StructType([*docs.schema.fields])
    for name in COUNTS:
        schema = schema.add(name, LongType())
    return map_pieces(docs, run, schema.add("quality", DoubleType()), text)


def base_failed():
    """The base rules: too short, or more than a fifth of the words inside repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
