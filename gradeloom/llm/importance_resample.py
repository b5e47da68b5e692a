"""Importance resampling with hashed n-gram models.

Texts are bags of hashed words and word pairs.  Two generative models over the hash buckets, one of
labelled target texts and one of all texts, give each text a log importance weight (the sum of log
ratios of its n-grams).  Gumbel noise seeded by the id is added, and the ``fraction`` of rows with
the largest sums is kept: a sample without replacement in proportion to the weights.

The k-th largest sum is found by narrowing histograms of bounded size, not by sorting in one task.

Defined results: null and empty texts have no n-grams and weight 0; a null id draws by its text;
rows that tie with the k-th are all kept; an empty table keeps nothing; without target rows all
weights are 0, so the sample is even; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from gradeloom.llm.deobfuscate import sample_labels
from gradeloom.llm.frames import NOT_SPACE, U, Texts, map_pieces, mix, pieces, written

BUCKETS, FRACTION, SEED = 10_000, 0.85, 7
#: Labelled target texts read at most.
TARGET_ROWS = 30_000
#: Rows of the last histogram bin brought to the driver at most.
LAST_BIN = 20_000


def buckets_of(texts: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbours, lower-cased."""
    words = texts.words(NOT_SPACE, lower=True)
    at, pair = words.windows(2)
    return (np.concatenate([words.text, words.text[at]]),
            (np.concatenate([mix(words.hashes), mix(pair + U(1))]) % U(buckets)).astype(np.int64))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """n-grams per bucket over all rows of ``docs``: one array per task, summed in Spark."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            total += np.bincount(buckets_of(Texts(piece.column("text")), buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    out = np.zeros(buckets)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def log_ratios(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TARGET_ROWS, buckets: int = BUCKETS) -> np.ndarray:
    """log of target over raw probability per bucket; the target is smoothed towards the raw model."""
    raw = bucket_counts(docs, buckets)
    target = bucket_counts(docs.join(sample_labels(labels, label, rows).where("y = 1"), "doc_id"), buckets)
    if not raw.sum() or not target.sum():
        return np.zeros(buckets)
    p = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
    strength = 10.0 * buckets
    q = (target + strength * p) / (target.sum() + strength)
    return np.log(q / p)


def kth_largest(table: DataFrame, column: str, k: int, bins: int = 2048, last: int = LAST_BIN) -> float | None:
    """The k-th largest value; each round keeps the histogram bin that holds it."""
    low, high = table.agg(F.min(column), F.max(column)).first()
    if k <= 0 or low is None:
        return None
    while low < high:
        inside = table.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(counts.collect(), key=lambda r: -r.bin):  # at most ``bins`` rows
            if k <= r.n:
                break
            k -= r.n
        low, high = r.low, r.high
        if r.n <= last:
            return sorted((x[0] for x in table.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)[k - 1]
    return low


def weighed(docs: DataFrame, ratios: np.ndarray, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_grams``, ``log_ratio`` and ``gumbel_key``."""
    handle = docs.sparkSession.sparkContext.broadcast(ratios)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_grams", "log_ratio", "gumbel_key", "kept")])

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(piece.column(text))
        owner, bucket = buckets_of(texts, len(handle.value))
        return pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.bincount(owner, minlength=texts.size)),
                                           pa.array(np.bincount(owner, handle.value[bucket], minlength=texts.size))], [*piece.schema.names, "n_grams", "log_ratio"])
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    drawn = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)
    schema = StructType([*docs.schema.fields]).add("n_grams", LongType()).add("log_ratio", DoubleType())
    return map_pieces(docs, run, schema, text).withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(drawn)))


def gumbel_top(scored: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """``scored`` with ``kept``: true for the ``fraction`` of rows with the largest ``gumbel_key``.

    The rows are written once, so leave out columns that are not needed.
    """
    scored = written(scored, "weights")
    bar = kth_largest(scored, "gumbel_key", round(fraction * scored.count()))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(bar) if bar is not None else F.lit(False))


def resampled(docs: DataFrame, ratios: np.ndarray, fraction: float = FRACTION, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the columns of ``weighed`` and ``kept``."""
    return gumbel_top(weighed(docs, ratios, seed, text, doc_id), fraction)
