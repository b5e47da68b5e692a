"""Text batches as byte arrays, and tables written to the cluster's shared folder.

The Python side of these operators works on Arrow batches: the texts of a batch lie in one
byte array, words are (start, end) positions in it, and word hashes come from prefix sums, so
no operator loops over characters.  Batches are cut into pieces of whole texts to bound memory.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.session import shared_dir

PIECE_BYTES = 1 << 19
#: Texts longer than this are read in slices by the operators that can.
SLICE_BYTES = 1 << 20
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A pseudo-random 64-bit value for every byte.
_BYTE_VALUES = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), "<u8").copy()

#: Bytes that are not ASCII white space (space and U+0009 to U+000D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and all bytes of other scripts.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _ODD, U), np.full(size, _INVERSE, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 20, 1 << int(size).bit_length()))


def release() -> None:
    """Give memory that a task no longer uses back to the machine; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


class Texts:
    """The texts of one piece: ``data`` holds their bytes, text i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.array([], pa.string())
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        low, high = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = self.offsets - low
        self.size = len(column)

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Texts:
        self = cls.__new__(cls)
        self.data, self.offsets, self.size = data, offsets, len(offsets) - 1
        return self

    def words(self, table: np.ndarray, lower: bool = False) -> Words:
        return Words(self, table, lower)

    def slices(self, table: np.ndarray, carry: int = 0, limit: int = SLICE_BYTES) -> Iterator[tuple[Texts, int, int]]:
        """(texts, number of the first one here, words carried over) of about ``limit`` bytes each.

        Short texts stay whole and go together.  A longer text is cut between words; every slice but its first
        begins with the last ``carry`` words of the slices before.
        """
        low = 0
        while low < self.size:
            high = max(low + 1, int(np.searchsorted(self.offsets, self.offsets[low] + limit, "right")) - 1)
            if self.offsets[high] - self.offsets[low] > limit:
                yield from self._cut(low, table, carry, limit)
            else:
                yield Texts.of(self.data[self.offsets[low]:self.offsets[high]], self.offsets[low:high + 1] - self.offsets[low]), low, 0
            low = high

    def _cut(self, i: int, table: np.ndarray, carry: int, limit: int) -> Iterator[tuple[Texts, int, int]]:
        start = at = int(self.offsets[i])
        end, carried = int(self.offsets[i + 1]), 0
        while at < end:
            stop = min(at + limit, end)
            if stop < end:
                gaps = np.flatnonzero(~table[self.data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                while not len(gaps) and stop < end:  # one word longer than a slice
                    gaps = np.flatnonzero(~table[self.data[stop:stop + limit]])
                    stop = stop + int(gaps[0]) if len(gaps) else min(stop + limit, end)
            here = self.data[start:stop]
            yield Texts.of(here, np.array([0, len(here)])), i, carried
            inside = table[here]
            first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            carried = min(carry, len(first))
            start = start + int(first[-carried]) if carried else stop
            at = stop

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


class Words:
    """Maximal runs of the bytes in ``table``; a word never crosses a text boundary."""

    def __init__(self, texts: Texts, table: np.ndarray, lower: bool):
        self.texts, self.data = texts, LOWER[texts.data] if lower else texts.data
        inside = table[texts.data]
        edge = texts.offsets[:-1][texts.offsets[:-1] < len(inside)]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: words of text i are first[i] up to first[i + 1]
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.first)

    @functools.cached_property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.size), self.counts)

    @functools.cached_property
    def sums(self) -> np.ndarray:
        up, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U)
        np.cumsum(_BYTE_VALUES[self.data] * up[:len(self.data)], out=out[1:])
        return out

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = powers(len(self.data) + 1)
        return mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(U))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self.hash_of(self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``size`` words of one text."""
        if len(self.hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        n = len(self.hashes) - size + 1
        first = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        h = np.zeros(len(first), U)
        for j in range(size):
            h = h * U(0xD6E8FEB86659FD93) + self.hashes[first + j]
        return first, mix(h)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole texts of about ``limit`` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)
    release()


def map_pieces(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """Apply ``fn`` to every piece of ``df`` inside the tasks."""
    def run(batches):
        for piece in pieces(batches, column):
            yield fn(piece)
    return df.mapInArrow(run, schema)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """A column name that does not clash with the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again, which cuts its lineage.

    The folder has a fresh name, so concurrent queries never meet.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the marks that ``maybe_in`` broadcasts: 4 MB in bitmaps of 32 768 bits.
MARK_BITS = 1 << 25


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, own: Column, name: str) -> DataFrame:
    """``df`` with a boolean ``name`` that is false only where no row of ``keys`` has the key; keys are 64-bit hashes.

    What is broadcast has a fixed size.  With more keys than bits most rows are marked, so marked rows must be joined anyway;
    with fewer, the others need not move.
    """
    bucket, bits = free_name(df.columns, "mark_bucket"), free_name(df.columns, "mark_bits")

    def spot(hash64: Column) -> Column:
        return F.pmod(hash64, F.lit(MARK_BITS))
    marks = keys.groupBy(F.floor(spot(own) / 32_768).alias(bucket)).agg(F.bitmap_construct_agg(F.pmod(spot(own), F.lit(32_768))).alias(bits))
    met = df.withColumn(bucket, F.floor(spot(key) / 32_768)).join(F.broadcast(marks), bucket, "left")
    place = F.pmod(spot(key), F.lit(32_768))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(1) == 1
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).drop(bucket, bits)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a 1-based ``name`` in the given order.

    Rows are numbered inside sorted range partitions, one row per partition gives the offsets, so no task holds every row.
    """
    at, part, before = (free_name([*df.columns, name], c) for c in ("at", "part", "before"))
    spread = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    spread = spread.withColumn(part, F.shiftright(at, 33))
    sizes = spread.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(sizes, part).withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, part, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(divisor)
