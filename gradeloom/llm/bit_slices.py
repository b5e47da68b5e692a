"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of like size.  A block is a matrix of bits stored by rows: a key
selects ``PROBES`` rows, and their conjunction marks the documents that may hold the key, never missing
one.  Keys are (term, level): a document that holds a term tf times has the keys of all ``LEVELS`` up to
tf, so the marks also bound tf from above.  Documents frequencies lie beside the blocks as sorted arrays.

A search reads the index only: the marks of a query's terms, each times the most its level can add to
a score, sum to an upper bound for every document and item (a product of a weight matrix with the
bitmaps).  The documents with the highest bounds are scored exactly first, their k-th best score bars
what can't be among the best, and all documents not excluded are scored exactly from their whole texts.
The result therefore never depends on the signatures.  Items go in blocks of bounded terms.

    score = sum over the item's terms of w ((10**9 tf) div (1000 tf + 20 m)),  w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m = 50 + (50 n N) div L

Terms are told apart by 64-bit hashes of their bytes.  Defined results: null and termless texts are not
counted and never found; null and termless items find nothing; each row of items is an item of its own,
each row of documents a document of its own; equal scores go by id, a null id last; empty tables give
no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.frames import U, Texts, WORD_BYTES, map_pieces, mix, pieces, written
from gradeloom.plans.scale import keep_top

TOP = 50
#: Term frequencies that have a key.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 128, 256)
PROBES, BITS_PER_KEY = 4, 11
#: Rows of a block at most; larger documents have fuller rows, so more of them are scored exactly.
MOST_BITS = 1 << 20
#: Documents of a block; documents and terms sorted by size before blocks are cut; terms in a row of frequencies.
BLOCK_DOCS, SORTED_DOCS, SORTED_TERMS, DICTIONARY = 512, 4096, 1 << 20, 1 << 20
#: Items, and their terms, searched together; one item may have more terms.
ITEMS, ITEM_TERMS = 256, 16_384
#: Documents of the highest bounds that are scored first, per item.
FIRST = 100
_MASKS = ITEMS // 64


def _summed(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], h[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def term_counts(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, occurrences), sorted by text and hash."""
    parts = []
    for part, first, _ in texts.slices(WORD_BYTES):
        words = part.words(WORD_BYTES, lower=True)
        parts.append(_summed(words.text + first, words.hashes, np.ones(len(words.starts), np.int64)))
    if len(parts) == 1:
        return parts[0]
    return _summed(*(np.concatenate(c) for c in zip(*parts))) if parts else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))


def probes(h: np.ndarray, level: np.ndarray | int, bits: int) -> Iterator[np.ndarray]:
    """The rows of the keys (h, level)."""
    a = mix(h + np.asarray(level).astype(U) * U(0xC2B2AE3D27D4EB4F))
    b = mix(a) | U(1)
    for _ in range(PROBES):
        yield (a % U(bits)).astype(np.int64)
        a = a + b


def signature(column: np.ndarray, h: np.ndarray, level: np.ndarray, docs: int, bits: int) -> np.ndarray:
    """Bits by rows; document i is bit i of every row."""
    grid = np.zeros((bits, -(-docs // 8) * 8), bool)
    for row in probes(h, level, bits):
        grid[row, column] = True
    return np.packbits(grid, axis=1)


INDEX = "docs long, terms_held long, keys binary, sizes binary, bits long, slices binary, terms binary, frequencies binary"


def _row(docs=None, held=None, keys=None, sizes=None, bits=None, slices=None, terms=None, frequencies=None) -> pa.RecordBatch:
    values = (docs, held, keys, sizes, bits, slices, terms, frequencies)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], k) for v, k in zip(values, kinds)],
                                      [c.split()[0] for c in INDEX.split(", ")])


def _blocks(keys: np.ndarray, owner: np.ndarray, h: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of documents of like size; ``owner`` numbers the documents of ``keys``."""
    levels = np.searchsorted(LEVELS, tf, "right")
    size = np.bincount(owner, tf, minlength=len(keys)).astype(np.int64)
    own_keys = np.bincount(owner, levels, minlength=len(keys)).astype(np.int64)
    like = np.floor(2 * np.log2(np.maximum(own_keys, 1))).astype(np.int64)
    order = np.argsort(like, kind="stable")
    order = order[own_keys[order] > 0]
    cuts = np.flatnonzero(np.diff(like[order])) + 1
    first = np.searchsorted(owner, np.arange(len(keys) + 1))
    for group in (g[low:low + BLOCK_DOCS] for g in np.split(order, cuts) for low in range(0, len(g), BLOCK_DOCS)):
        terms = np.concatenate([np.arange(first[d], first[d + 1]) for d in group])
        count = levels[terms]
        at = np.repeat(terms, count)
        level = np.array(LEVELS)[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]
        column = np.repeat(np.arange(len(group)), own_keys[group])
        bits = int(min(MOST_BITS, max(64, BITS_PER_KEY * own_keys[group].max())))
        yield _row(len(group), int(size[group].sum()), keys[group], size[group], bits, signature(column, h[at], level, len(group), bits))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index of all rows of ``docs``, written to the shared folder: block rows and rows of document frequencies."""
    def run(batches):
        keys, terms, base, held = [], [], 0, 0
        pending, known = [], 0

        def blocks():
            owner, h, tf = (np.concatenate(c) for c in zip(*terms))
            yield from _blocks(np.concatenate(keys), owner, h, tf)
            pending.append(np.unique(h, return_counts=True))

        def merged():
            h, n = (np.concatenate(c) for c in zip(*pending))
            order = np.argsort(h, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) > 0]))
            return h[order][at], np.add.reduceat(n[order], at)

        for piece in pieces(batches):
            owner, h, tf = term_counts(Texts(piece.column("text")))
            keys.append(piece.column("key").to_numpy())
            terms.append((owner + base, h, tf))
            base, held = base + piece.num_rows, held + len(h)
            if base >= SORTED_DOCS or held >= SORTED_TERMS:
                if held:
                    yield from blocks()
                keys, terms, base, held = [], [], 0, 0
                known = sum(len(h) for h, _ in pending)
                if known >= 2 * DICTIONARY:
                    pending = [merged()]
                    if len(pending[0][0]) >= DICTIONARY:
                        yield _row(terms=pending[0][0], frequencies=pending[0][1].astype(np.int64))
                        pending = []
        if held:
            yield from blocks()
        if pending:
            h, n = merged()
            yield _row(terms=h, frequencies=n.astype(np.int64))
    return written(docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text")).mapInArrow(run, INDEX), "index")


class Questions:
    """A block of items: its terms in order of hash, and which item holds which."""

    def __init__(self, texts: list[str | None]):
        owner, h, _ = term_counts(Texts(pa.array(texts, pa.string())))
        self.terms = np.unique(h)
        self.held = np.zeros((len(self.terms), len(texts)))
        self.held[np.searchsorted(self.terms, h), owner] = 1
        self.weights = np.zeros(len(self.terms))

    def weigh(self, frequencies: dict[int, int], docs: int, held: int) -> Questions:
        self.docs, self.total = docs, held
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * frequencies.get(i, 0) + 1))) for i in range(len(self.terms))], float)
        return self

    def spread(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents of these sizes, in whole numbers of any length."""
        return np.array([50 + 50 * n * self.docs // self.total for n in sizes.tolist()], np.int64)

    def bounds(self, bits: int, slices: bytes, sizes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of all items (rows) for all documents of a block (columns)."""
        rows = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        m, alive, marks = self.spread(sizes), np.arange(len(self.terms)), None
        most = np.zeros((len(self.terms), len(sizes)))
        before = np.zeros(len(sizes))
        for level, upper in zip(LEVELS, [*LEVELS[1:], None]):
            found = reduce(np.bitwise_and, (rows[row] for row in probes(self.terms[alive], level, bits)))
            if marks is not None:
                found &= marks
            some = found.any(axis=1)
            alive, marks = alive[some], found[some]
            if not len(alive):
                break
            tf = np.minimum(sizes, upper - 1) if upper else sizes
            now = gain(tf, m).astype(float)
            most[alive] += np.unpackbits(marks, axis=1, count=len(sizes)) * (now - before)
            before = now
        return (self.held * self.weights[:, None]).T @ most

    def scores(self, texts: Texts) -> np.ndarray:
        """Exact scores of all items (columns) for all texts (rows)."""
        owner, h, tf = term_counts(texts)
        sizes = np.bincount(owner, tf, minlength=texts.size).astype(np.int64)
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        ours = np.flatnonzero(self.terms[at] == h) if len(self.terms) else np.zeros(0, np.int64)
        owner, at, tf = owner[ours], at[ours], tf[ours]
        part = np.zeros((texts.size, len(self.terms)))
        part[owner, at] = self.weights[at] * gain(tf, self.spread(sizes)[owner])
        return part @ self.held  # whole numbers below 2**53


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Documents that hold each of ``terms``, by position."""
    handle = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted, total = handle.value, np.zeros(len(handle.value), np.int64)
        for batch in batches:
            for known, counts in zip(batch.column("terms"), batch.column("frequencies")):
                h, n = np.frombuffer(known.as_buffer(), U), np.frombuffer(counts.as_buffer(), np.int64)
                at = np.searchsorted(h, wanted)
                at[at == len(h)] = 0
                same = h[at] == wanted
                total[same] += n[at[same]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])
    counts = index.where("terms is not null").select("terms", "frequencies").mapInArrow(run, "term long, n long")
    return {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most one row a term


def _each_block(batches) -> Iterator[tuple[np.ndarray, np.ndarray, int, bytes]]:
    for batch in batches:
        for keys, sizes, bits, slices in zip(*(batch.column(c) for c in ("keys", "sizes", "bits", "slices"))):
            yield np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int64), bits.as_py(), slices.as_buffer()


def _highest(blocks: DataFrame, handle, first: int) -> DataFrame:
    """(item, key, bound): per task and item the documents of the highest bounds."""
    def run(batches):
        best = keys = None
        for names, sizes, bits, slices in _each_block(batches):
            bound = handle.value.bounds(bits, slices, sizes)
            named = np.broadcast_to(names, bound.shape)
            if best is not None:
                bound, named = np.concatenate([best, bound], axis=1), np.concatenate([keys, named], axis=1)
            if bound.shape[1] > first:
                at = np.argpartition(-bound, first - 1, axis=1)[:, :first]
                bound, named = np.take_along_axis(bound, at, 1), np.take_along_axis(named, at, 1)
            best, keys = bound, named
        if best is not None:
            item, column = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(keys[item, column]), pa.array(best[item, column])], ["item", "key", "bound"])
    return keep_top(blocks.mapInArrow(run, "item int, key long, bound double"), ["item"], [F.col("bound").desc(), F.col("key")], first)


def _not_excluded(blocks: DataFrame, handle, bars: np.ndarray) -> DataFrame:
    """(key, m0, m1...): documents whose bound reaches the bar of some item, with the bits of those items."""
    def run(batches):
        for names, sizes, bits, slices in _each_block(batches):
            bound = handle.value.bounds(bits, slices, sizes)
            open_ = np.zeros((len(names), ITEMS), bool)
            open_[:, :len(bound)] = (bound >= bars[:, None]).T
            some = np.flatnonzero(open_.any(axis=1))
            masks = np.packbits(open_[some], axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), *[pa.array(np.ascontiguousarray(masks[:, j])) for j in range(_MASKS)]],
                                             ["key", *[f"m{j}" for j in range(_MASKS)]])
    return blocks.mapInArrow(run, "key long, " + ", ".join(f"m{j} long" for j in range(_MASKS)))


def _scored(docs: DataFrame, wanted: DataFrame, handle, top: int) -> DataFrame:
    """(item, doc_id, score): exact scores of the wanted documents, the best ``top`` of each task and item."""
    names = [f"m{j}" for j in range(_MASKS)]
    wanted = wanted.groupBy("key").agg(*[F.bit_or(c).alias(c) for c in names])
    kind = docs.schema["doc_id"].dataType
    met = docs.withColumn("key", F.xxhash64("doc_id", "text")).join(wanted, "key").select("doc_id", "text", *names)

    def run(batches):
        held = None
        for piece in pieces(batches):
            for low in range(0, piece.num_rows, 256):  # bounds the table of texts and terms
                part = piece.slice(low, 256)
                masks = np.stack([part.column(c).to_numpy() for c in names], axis=1)
                score = handle.value.scores(Texts(part.column("text"))).astype(np.int64)
                open_ = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :score.shape[1]].astype(bool)
                row, item = np.nonzero(open_ & (score > 0))
                found = pa.table({"item": pa.array(item.astype(np.int32)), "doc_id": part.column("doc_id").take(pa.array(row)), "score": pa.array(score[row, item])})
                found = found if held is None else pa.concat_tables([held, found])
                held = _best(found, top)
        if held is not None:
            yield from held.combine_chunks().to_batches()
    return met.mapInArrow(run, f"item int, doc_id {kind.simpleString()}, score long")


def _best(found: pa.Table, top: int) -> pa.Table:
    found = found.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    item = found.column("item").to_numpy()
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return found.filter(pa.array(place < top))


def _item_blocks(items: DataFrame, limit: int, terms: int) -> Iterator[list]:
    """Rows (item_id, text) of blocks of about so many items and terms, in hash order."""
    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(term_counts(Texts(piece.column("text")))[0])])], ["n"])
    total, held = items.count(), map_pieces(items.select("text"), count, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // limit), -(-held // terms))
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == number).select("item_id", "text").collect()
        for low in range(0, len(rows), ITEMS):
            yield rows[low:low + ITEMS]


def search(index: DataFrame, docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
           item_id: str = "item_id", first: int = FIRST, block_items: int = ITEMS, block_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item; ``index`` is ``build_index(docs)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = written(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("at")), "items")
    blocks = index.where("slices is not null").select("keys", "sizes", "bits", "slices")
    n, held = index.agg(F.sum("docs"), F.sum("terms_held")).first()
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    results = [spark.createDataFrame([], kinds)]
    for rows in _item_blocks(items, block_items, block_terms) if n else ():
        questions = Questions([r.text for r in rows])
        if not len(questions.terms):
            continue
        handle = spark.sparkContext.broadcast(questions.weigh(_frequencies(index, questions.terms), n, held))
        early = _highest(blocks, handle, first)
        masks = [F.when(F.shiftright("item", 6) == j, F.expr("shiftleft(1L, item & 63)")).otherwise(F.lit(0).cast("long")).alias(f"m{j}") for j in range(_MASKS)]
        early = written(early.select("key", *masks), "early")
        worst = keep_top(_scored(docs, early, handle, top), ["item"], order, top).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
        bars = np.ones(len(rows))
        for r in worst.collect():  # one row an item
            bars[r["item"]] = r.score if r.n == top else 1
        late = written(_not_excluded(blocks, handle, bars), "late")
        best = keep_top(_scored(docs, late, handle, top), ["item"], order, top, rank="rank")
        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        results.append(best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, results)
