"""Interpolated modified Kneser-Ney bigram model, counted in Spark, read by workers from mapped files.

Counting is one pass: tasks send distinct word pairs, packed by shard of the context's hash, to the
shard's task, which merges them, writes sorted hash arrays to the shared folder and passes the
number of left neighbours of each word on to that word's shard.  Contexts frequent in a sample are
spread over all shards; the sample only decides where they are counted.  Files are written under a
temporary name and renamed, so a task may run again.

Scoring maps the arrays into memory shard by shard and looks sorted queries up by bisection; the
model is never loaded whole, and its size follows the training text.

    p(w | c) = max(n(c, w) - D(n), 0) / n(c) + g(c) p1(w)
    p1(w)    = max(left(w) - D1(left), 0) / pairs + g1 / (V + 1)

with three discounts per order from the counts of counts.  A context never seen passes to p1.

Tokens are ASCII lower-cased runs of bytes other than ASCII white space, then one end per text.
Words are hashes of 64 bits for single counts, of 40 bits inside pairs.

Defined results: null and empty texts have one token, the end; without training rows every
probability is 1 and scores are 0; repeated rows count and are scored each; extra columns stay.
"""

from __future__ import annotations

import dataclasses
import functools
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from gradeloom.llm.frames import NOT_SPACE, U, Texts, mix, pieces
from gradeloom.session import shared_dir

END, START = U(0x1F0E1D2C3B4A5968), U(0x7A6B5C4D3E2F1021)
FLUSH_TOKENS = 2_000_000
#: One text in so many is looked at to find contexts worth spreading.
HOT_SAMPLE = 64
_SHIFT = U(24)


def tokens(piece_text) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, tokens per text)."""
    words = Texts(piece_text).words(NOT_SPACE, lower=True)
    counts = words.counts + 1
    out = np.full(int(counts.sum()), END, U)
    stops = np.cumsum(counts) - 1
    inner = np.ones(len(out), bool)
    inner[stops] = False
    out[inner] = words.hashes
    return out, counts


def contexts(token: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(counts) - counts] = START
    return before


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a pair of 40-bit hashes."""
    return mix(context * U(0xD6E8FEB86659FD93) + word)


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _grouped(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a row that holds each, and the sum of n."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, int)
    return ordered[first], order[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, n.dtype)


def _save(path: str, arrays: list[np.ndarray]) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(np.array([len(a) for a in arrays], "<i8").tobytes())
        for a in arrays:
            f.write(a.tobytes())
    os.replace(temporary, path)


@functools.lru_cache(maxsize=256)
def _load(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of one file, mapped.  Only files that were written are asked for: one that is missing is an error."""
    data, out = np.memmap(path, np.uint8, "r"), []
    at = 8 * len(kinds)
    for k, n in zip(kinds, data[:at].view("<i8").tolist()):
        size = n * np.dtype(k).itemsize
        out.append(data[at:at + size].view(k))
        at += size
    return out


#: Contexts, pairs, words; n1 n2 n3 total of contexts; n of pairs; n of words; places and counts of pairs that 32 bits don't hold.
PAIR_FILE = ("<u8", "<u8", "<u8", "<u8", "<u8", "<u8", "<u8", "<u4", "<u8", "<u8", "<u8")
LEFT_FILE = ("<u8", "<u8")
WIDE = (1 << 32) - 1
#: Bytes of text that a shard counts at most, on average.
SHARD_BYTES = 64 << 20


def _route(hash40: np.ndarray, shards: int) -> np.ndarray:
    return (hash40 % U(shards)).astype(np.int64)


def _send(batches: Iterator[pa.RecordBatch], shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct pairs and words of the task, packed by shard: (shard, kind, a, runs, b, n)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        if not held:
            return None
        token, before = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        word, context = token >> _SHIFT, before >> _SHIFT
        _, at, n = _grouped(pair_key(context, word), np.ones(len(token), np.uint32))
        context, word = context[at], word[at]
        shard = _route(np.where(np.isin(context, hot), context + word, context), shards)
        order = np.lexsort((word, context, shard))
        context, word, n, shard = context[order], word[order], n[order].astype("<u4"), shard[order]
        rows = []
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.unique(shard).tolist():
            here = slice(cuts[s], cuts[s + 1])
            c, runs = np.unique(context[here], return_counts=True)
            rows.append((s, 0, _pack(c), runs.astype("<u4").tobytes(), _pack(word[here]), n[here].tobytes()))
        single, _, n = _grouped(token, np.ones(len(token), np.uint32))
        shard = _route(single >> _SHIFT, shards)
        order = np.argsort(shard, kind="stable")
        single, n, shard = single[order], n[order].astype("<u4"), shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        rows += [(s, 1, single[cuts[s]:cuts[s + 1]].tobytes(), b"", b"", n[cuts[s]:cuts[s + 1]].tobytes()) for s in np.unique(shard).tolist()]
        return _rows(rows)

    for piece in pieces(batches):
        token, counts = tokens(piece.column("text"))
        held.append((token, contexts(token, counts)))
        if sum(len(h[0]) for h in held) >= FLUSH_TOKENS:
            yield flush()
    last = flush()
    if last is not None:
        yield last


_SENT = "shard int, kind int, a binary, runs binary, b binary, n binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["shard", "kind", "a", "runs", "b", "n"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by shard, one shard at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != now:
                if held:
                    yield now, held
                now, held = row["shard"], []
            held.append(row)
    if held:
        yield now, held


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5).astype(int), minlength=6)[1:5].tolist()


def _stats(shard: int, kind: int, keys: list[int] | np.ndarray, values: list[list[int]] | np.ndarray) -> tuple:
    """One row of statistics: the values of every key, summed by key where they arrive."""
    return (shard, kind, np.asarray(keys, "<i8").tobytes(), b"", b"", np.asarray(values, "<i8").tobytes())


def _merge(batches, shards: int, hot: np.ndarray, folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """Write each shard's contexts, pairs and words; pass on numbers of left neighbours and statistics."""
    for shard, rows in _by_shard(batches):
        pair_rows, word_rows = ([r for r in rows if r["kind"] == k] for k in (0, 1))
        context = np.concatenate([np.zeros(0, U), *[np.repeat(_unpack(r["a"]), np.frombuffer(r["runs"], "<u4")) for r in pair_rows]])
        word = np.concatenate([np.zeros(0, U), *[_unpack(r["b"]) for r in pair_rows]])
        n = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(r["n"], "<u4") for r in pair_rows]])
        key, at, n = _grouped(pair_key(context, word), n.astype(np.uint64))
        context, word = context[at], word[at]
        c, place = np.unique(context, return_inverse=True)
        per = [np.bincount(place, w, minlength=len(c)).astype(np.int64) for w in (n == 1, n == 2, n >= 3, n)]
        spread = np.isin(c, hot)
        own, to = np.stack(per, axis=1)[spread], _route(c[spread], shards)
        out = [_stats(s, 3, c[spread][to == s], own[to == s]) for s in np.unique(to).tolist()]
        single, _, many = _grouped(np.concatenate([np.zeros(0, U), *[np.frombuffer(r["a"], "<u8") for r in word_rows]]),
                                   np.concatenate([np.zeros(0, U), *[np.frombuffer(r["n"], "<u4") for r in word_rows]]).astype(np.uint64))
        _save(f"{folder}/pairs-{shard:06d}", [c[~spread], key, single, *[p[~spread].astype("<u8") for p in per],
                                                 np.minimum(n, most).astype("<u4"), many.astype("<u8"), *(x.astype("<u8") for x in wide(n, most))])
        out.append(_stats(shard, 4, [0, shard + 1], [[*_counts_of_counts(n), int(many.sum()), len(single)], [1, 0, 0, 0, 0, 0]]))
        w, left = np.unique(word, return_counts=True)
        to = _route(w, shards)
        order = np.argsort(to, kind="stable")
        w, left, to = w[order], left[order].astype("<u8"), to[order]
        cuts = np.searchsorted(to, np.arange(shards + 1))
        out += [(s, 2, _pack(w[cuts[s]:cuts[s + 1]]), b"", b"", left[cuts[s]:cuts[s + 1]].tobytes()) for s in np.unique(to).tolist()]
        yield _rows(out)


def _finish(batches, folder: str) -> Iterator[pa.RecordBatch]:
    """Write each shard's left-neighbour counts; what remains are statistics (kind, key, values)."""
    for shard, rows in _by_shard(batches):
        out = []
        for kind, size in ((3, 4), (4, 6)):
            held = [r for r in rows if r["kind"] == kind]
            if held:
                keys, place = np.unique(np.concatenate([np.frombuffer(r["a"], "<i8") for r in held]), return_inverse=True)
                values = np.zeros((len(keys), size), np.int64)
                np.add.at(values, place, np.concatenate([np.frombuffer(r["n"], "<i8").reshape(-1, size) for r in held]))
                out += [(kind, k, v) for k, v in zip(keys.tolist(), values.tolist())]
        own = [r for r in rows if r["kind"] == 2]
        if own:
            w, _, left = _grouped(np.concatenate([_unpack(r["a"]) for r in own]), np.concatenate([np.frombuffer(r["n"], "<u8") for r in own]))
            _save(f"{folder}/left-{shard:06d}", [w, left.astype("<u8")])
            out += [(5, 0, [*_counts_of_counts(left), int(left.sum()), len(w)]), (5, shard + 1, [1])]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                                          pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["kind", "key", "v"])


def wide(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the counts that ``most``, the largest of their type, doesn't hold."""
    at = np.flatnonzero(n >= most)
    return at, n[at]


@dataclasses.dataclass
class Model:
    """What is small: folder, sizes, files written, discounts and the statistics of the spread contexts."""

    folder: str
    shards: int
    total: int
    distinct: int
    pairs: int
    pair_discounts: np.ndarray
    left_discounts: np.ndarray
    left_rest: float
    hot: np.ndarray
    hot_stats: np.ndarray
    pair_files: frozenset[int]
    left_files: frozenset[int]


def discounts(n: list[int]) -> np.ndarray:
    """D(0)=0, D(1), D(2), D(3 and more) from counts of counts; 0.5 k where they are undefined."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else 0.5 * k
        out.append(min(max(d, 0.0), k))
    return np.array(out)


def _folder(spark) -> str:
    """A folder that all machines see as a path, since files are mapped from it."""
    url = urlparse(shared_dir(spark, "ngrams"))
    if url.scheme not in ("", "file"):
        raise ValueError("model files are mapped into memory: spark.checkpoint.dir must be a mounted path")
    return url.path


def count_model(train: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    spark = train.sparkSession
    rows = train.select(F.col(text).alias("text"))
    if shards is None:  # the session's number of partitions, or more where the text asks for it
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = _folder(spark)
    os.makedirs(folder, exist_ok=True)

    def frequent(batches):
        for piece in pieces(batches):
            token, counts = tokens(piece.column("text"))
            c, n = np.unique(contexts(token, counts) >> _SHIFT, return_counts=True)
            often = n * 8 * shards > len(token)
            yield pa.RecordBatch.from_arrays([pa.array(c[often].astype(np.int64)), pa.array(n[often], pa.int64()), pa.array(np.full(often.sum(), len(token)), pa.int64())], ["c", "n", "of"])
    seen = rows.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(frequent, "c long, n long, of long").groupBy("c").agg(F.sum("n").alias("n"))
    hot = np.array(sorted(r.c for r in seen.orderBy(F.desc("n"), "c").limit(8 * shards).collect()), U)

    sent = rows.mapInArrow(lambda b: _send(b, shards, hot), _SENT)
    most = WIDE
    merged = sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lambda b: _merge(b, shards, hot, folder, most), _SENT)
    done = merged.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lambda b: _finish(b, folder), "kind int, key long, v array<long>")
    sums = done.groupBy("kind", "key").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(6)])
    found = {(r.kind, r.key): [r[f"v{i}"] or 0 for i in range(6)] for r in sums.collect()}  # the spread contexts, two rows and one a file
    pair, left = found.get((4, 0), [0] * 6), found.get((5, 0), [0] * 6)
    d, one = discounts(pair[:4]), discounts(left[:4])
    pairs = left[4]
    rest = (one[1] * left[0] + one[2] * left[1] + one[3] * (left[5] - left[0] - left[1])) / pairs if pairs else 1.0
    spread = sorted(k for kind, k in found if kind == 3)
    return Model(folder, shards, pair[4], pair[5], pairs, d, one, rest, np.array(spread, U), np.array([found[(3, k)][:4] for k in spread], float).reshape(-1, 4),
                 *(frozenset(k - 1 for kind, k in found if kind == which and k) for which in (4, 5)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of sorted ``wanted`` in sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def look_up(model: Model, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 p, count of the token) of every (context, token); equal pairs are looked up once."""
    c40, w40 = context >> _SHIFT, token >> _SHIFT
    key = pair_key(c40, w40) ^ (token << U(40))
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    back = np.empty(len(key), int)
    back[order] = np.repeat(np.arange(len(first)), np.diff([*first, len(key)]))
    some = order[first]
    c40, w40, token = c40[some], w40[some], token[some]
    n, count, left = (np.zeros(len(some)) for _ in range(3))
    stats = np.zeros((len(some), 4))
    is_hot = np.isin(c40, model.hot)
    at, there = _find(model.hot, c40)
    stats[there] = model.hot_stats[at[there]]

    def by_shard(shard: np.ndarray, value: np.ndarray):
        order = np.lexsort((value, shard))
        cuts = np.searchsorted(shard[order], np.arange(model.shards + 1))
        for s in range(model.shards):
            if cuts[s] < cuts[s + 1]:
                rows = order[cuts[s]:cuts[s + 1]]
                yield s, rows, value[rows]

    def shard_file(s: int):
        return _load(f"{model.folder}/pairs-{s:06d}", PAIR_FILE) if s in model.pair_files else [np.zeros(0, k) for k in PAIR_FILE]

    pair = pair_key(c40, w40)
    for s, rows, v in by_shard(_route(np.where(is_hot, c40 + w40, c40), model.shards), pair):
        file = shard_file(s)
        at, there = _find(file[1], v)
        found = file[7][at[there]].astype(float)
        big, known = _find(file[9], at[there].astype(U))
        found[known] = file[10][big[known]]
        n[rows[there]] = found
    plain = np.flatnonzero(~is_hot)
    for s, rows, v in by_shard(_route(c40[plain], model.shards), c40[plain]):
        file = shard_file(s)
        at, there = _find(file[0], v)
        for j in range(4):
            stats[plain[rows[there]], j] = file[3 + j][at[there]]
    own = _route(w40, model.shards)
    for s, rows, v in by_shard(own, token):
        file = shard_file(s)
        at, there = _find(file[2], v)
        count[rows[there]] = file[8][at[there]]
    for s, rows, v in by_shard(own, w40):
        if s not in model.left_files:
            continue
        words, lefts = _load(f"{model.folder}/left-{s:06d}", LEFT_FILE)
        at, there = _find(words, v)
        left[rows[there]] = lefts[at[there]]

    d, one = model.pair_discounts, model.left_discounts
    low = (left - one[np.minimum(left, 3).astype(int)]) / max(model.pairs, 1) + model.left_rest / (model.distinct + 1)
    total = stats[:, 3]
    rest = np.where(total > 0, stats[:, :3] @ d[1:] / np.maximum(total, 1), 1.0)
    p = (n - d[np.minimum(n, 3).astype(int)]) / np.maximum(total, 1) + rest * low
    return np.log10(p)[back], count[back]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10) and ``perplexity``."""
    fresh = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in fresh])
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in pieces(batches, text, 4 << 20):
            m = handle.value
            token, counts = tokens(piece.column(text))
            log, count = look_up(m, contexts(token, counts), token)
            at = np.cumsum(counts) - counts
            base = np.log10((count + 1) / (m.total + m.distinct + 1))
            total = np.add.reduceat(log, at)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(counts, pa.int64()), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                 pa.array(np.add.reduceat(base, at)), pa.array(total), pa.array(10.0 ** np.minimum(-total / counts, 300))], [*piece.schema.names, *fresh])
    schema = StructType([*docs.schema.fields])
    for name in fresh:
        schema = schema.add(name, LongType() if name.startswith("n_") else DoubleType())
    return docs.mapInArrow(run, schema)
