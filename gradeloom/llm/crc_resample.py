"""Importance resampling towards target texts, with features hashed in length-bucketed CRC matrices.

Features are runs of one to three words.  In a slice of texts, words get numbers, so a feature is a
small tuple of numbers and equal features are found as equal integers.  The bytes of the distinct
features are grouped by length into two-dimensional arrays of bytes; a CRC-32 state per feature
moves over the columns of its array, all rows at once, and the buckets are scattered back to the
occurrences.  Of features longer than ``BLOCK`` bytes the blocks are the rows of one more array; their
states are folded with the operator that appends a block of zeros, since CRCs are linear.

One pass counts buckets (one array per task, summed in Spark), a second sums the gains of every
text; ``BUCKETS`` gains are all that is broadcast.  The draw finds the lowest drawn score by narrowing
histograms and numbers the drawn rows inside range partitions.

Defined results: null and wordless texts have no features and weight 0; a null id draws as the empty
id and comes last among ties; repeated rows are scored and ranked each; empty tables give no rows;
without target texts every gain follows from the counts alike; extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.frames import WORD_BYTES, Texts, Words, map_pieces, numbered, pieces, written
from gradeloom.llm.importance_resample import kth_largest

BUCKETS, RUN, MIN_WORDS, SEED = 10_000, 3, 20, 42
#: Drawn share of the texts with enough words, as a fraction.
SHARE = (5, 100)
BLOCK = 1024
#: Blocks of long features in one array.
ROWS = 1024


def _byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> np.uint32(1)) ^ (state & np.uint32(1)) * np.uint32(0xEDB88320)
    return state


TABLE = _byte_table()


def advance(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """States after the bytes of ``columns`` (length x rows), one column of all rows at a time."""
    for column in columns:
        state = TABLE[(state ^ column) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    return state


def _zero_block() -> list[list[int]]:
    """What ``BLOCK`` zero bytes make of each byte of a state."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).ravel()
    return advance(state, np.zeros((BLOCK, 1), np.uint8)).reshape(4, 256).tolist()


ZERO_BLOCK = _zero_block()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every ``data[start:end]``."""
    size = ends - starts
    head = np.where(size > BLOCK, size % BLOCK, size)
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(head, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(head[order])) + 1):
        if len(group):
            columns = data[starts[group][None, :] + np.arange(head[group[0]])[:, None]]
            state[group] = advance(state[group], columns)
    long = np.flatnonzero(size > head)
    if len(long):
        count = (size - head)[long] // BLOCK
        at = np.repeat((starts + head)[long], count) + BLOCK * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        own = iter(np.concatenate([advance(np.zeros(len(a), np.uint32), data[a[None, :] + np.arange(BLOCK)[:, None]])
                                   for a in np.split(at, range(ROWS, len(at), ROWS))]).tolist())
        z0, z1, z2, z3 = ZERO_BLOCK
        for i, n in zip(long.tolist(), count.tolist()):
            s = int(state[i])
            for _ in range(n):
                s = z0[s & 255] ^ z1[s >> 8 & 255] ^ z2[s >> 16 & 255] ^ z3[s >> 24] ^ next(own)
            state[i] = s
    return state ^ np.uint32(0xFFFFFFFF)


def word_numbers(words: Words, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words of ``data``, where words are followed by a space."""
    _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    same = first[number]
    size = ends - starts
    if (size == size[same]).all() and (data == data[np.arange(len(data)) - np.repeat(starts - starts[same], size + 1)]).all():
        return number
    return np.arange(len(starts))  # two words share a hash: each occurrence counts for itself


def buckets_of(texts: Texts, carried: int = 0, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence that ends after the ``carried`` words, and the words of each text."""
    words = texts.words(WORD_BYTES, lower=True)
    counts = words.counts.copy()
    counts[:1] -= carried
    n = len(words.starts)
    if n <= carried:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    data, inside = np.full(ends[-1] + 1, 0x20, np.uint8), np.ones(ends[-1] + 1, bool)
    inside[ends] = False
    data[inside] = words.data[WORD_BYTES[texts.data]]
    number = word_numbers(words, data, starts, ends) + 1
    base, text = int(number.max()) + 1, words.text
    keys, begin, finish = [], [], []
    key = np.zeros(n, np.int64)
    for k in range(run):  # the words before the last one come in front
        last = np.arange(k, n)
        key = key[(1 if k else 0):] if k else key
        key = key + number[:n - k] * base ** k
        fits = (text[:n - k] == text[k:]) & (last >= carried)
        keys.append(key[fits])
        begin.append(starts[:n - k][fits])
        finish.append(last[fits])
    finish = np.concatenate(finish)
    _, where, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    crc = crc32s(data, np.concatenate(begin)[where], ends[finish[where]])
    return text[finish], (crc % np.uint32(buckets)).astype(np.int64)[back], counts


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features per bucket over all rows of ``docs``."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            for part, _, carried in Texts(piece.column("text")).slices(WORD_BYTES, run - 1):
                total += np.bincount(buckets_of(part, carried, buckets, run)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(docs: DataFrame, targets: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Thousandths of the log ratio of target to raw probability per bucket, rounded down."""
    raw, target = bucket_counts(docs, text, buckets, run).tolist(), bucket_counts(targets, target_text, buckets, run).tolist()
    all_raw, all_target = float(sum(raw) + buckets), float(sum(target) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw, target)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, ratios: np.ndarray, text: str = "text", doc_id: str = "doc_id", run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``."""
    handle = docs.sparkSession.sparkContext.broadcast(ratios)

    def sums(piece: pa.RecordBatch) -> pa.RecordBatch:
        ratio = handle.value
        words, features, weight = (np.zeros(piece.num_rows, np.int64) for _ in range(3))
        for part, first, carried in Texts(piece.column("text")).slices(WORD_BYTES, run - 1):
            owner, bucket, counts = buckets_of(part, carried, len(ratio), run)
            rows = slice(first, first + part.size)
            words[rows] += counts
            features[rows] += np.bincount(owner, minlength=part.size)
            weight[rows] += np.bincount(owner, ratio[bucket], minlength=part.size).astype(np.int64)  # whole numbers below 2**53
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), *map(pa.array, (words, features, weight))],
                                          ["doc_id", "n_words", "n_features", "weight"])
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    summed = map_pieces(plain, sums, f"doc_id {kind}, n_words long, n_features long, weight long")
    return summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def drawn(scored: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the share of rows with enough words that score highest, else null."""
    scored = written(scored, "scores")
    able = F.col("n_words") >= min_words
    k = share[0] * scored.where(able).count() // share[1]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = able & (F.col("score") >= kth_largest(scored.where(able), "score", k))
    top = numbered(scored.where(high), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    top = top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return top.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))
