"""Packing token sequences by first-fit decreasing in randomised groups of documents.

Texts are tokenised in the tasks and cut into pieces of at most one sequence.  Pieces get random
slots; a group is a residue of the slot, so every group is a fair sample of about ``GROUP`` pieces
and groups are packed independently.  In a group pieces go, longest first, into the first sequence
with room; a tournament tree over the room left in all sequences (every inner node holds the most
room below it) finds that sequence in one walk from the root.

Tokenising: a byte-level pre-tokeniser never joins a visible character with white space after it, so
texts fall into chunks of white space and what follows, and each distinct chunk of a slice is
tokenised once; its ids are scattered back to all places that hold it.  Chunks of earlier slices are
remembered, up to a bound, and told apart by their bytes.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; ids of
documents may be null or equal; an empty table gives no rows; strings that look like special tokens
are ordinary text; of extra columns none is carried.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from tokenizers import Tokenizer

from gradeloom.llm.chosen_path import _whole_groups
from gradeloom.llm.frames import NOT_SPACE, U, Texts, Words, free_name, mix, pieces, written

SEQUENCE, END_ID = 2048, 1
#: Pieces in a group, on average.
GROUP = 8192
#: Bytes of text whose distinct chunks are tokenised together.
SLICE = 1 << 21
#: Bytes of chunks that a worker remembers, and of one such chunk.
MEMORY, CHUNK = 1 << 23, 48


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Memory:
    """Ids of chunks seen before, found by hash and compared by bytes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.data, self.ids = np.zeros(0, U), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.at, self.size, self.first, self.count = (np.zeros(0, np.int64) for _ in range(4))

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Place of each chunk, -1 for those not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        maybe = np.flatnonzero((self.hashes[place] == hashes) & (self.size[place] == sizes))
        size = sizes[maybe]
        same = self.data[ranges(self.at[place[maybe]], size)] == data[ranges(starts[maybe], size)]
        hit = maybe[np.logical_and.reduceat(same, np.cumsum(size) - size)] if len(maybe) else maybe
        out = np.full(len(hashes), -1)
        out[hit] = place[hit]
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(self.data) > MEMORY:
            self.clear()
        short = np.flatnonzero(sizes <= CHUNK)
        first = np.cumsum(counts) - counts
        taken = counts[short]
        at, own = np.cumsum(sizes[short]) - sizes[short] + len(self.data), np.cumsum(taken) - taken + len(self.ids)
        self.data = np.concatenate([self.data, data[ranges(starts[short], sizes[short])]])
        self.ids = np.concatenate([self.ids, ids[ranges(first[short], taken)]])
        merged = np.concatenate([self.hashes, hashes[short]])
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.at, self.size, self.first, self.count = (np.concatenate(p)[order] for p in (
            (self.at, at), (self.size, sizes[short]), (self.first, own), (self.count, taken)))


class Encoder:
    """Ids of texts by a byte-level tokeniser without normaliser."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: bytes of every id: a vocabulary string has one character for each
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(v) for v in vocabulary]
        self.memory = Memory()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunk_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has)."""
        last = data[ends - 1]
        plain = ~NOT_SPACE[data[starts]] & (last > 0x20) & (last < 0x7F)  # may stand in a row without changing each other's ids
        counts, own = np.zeros(len(starts), np.int64), np.empty(len(starts), object)
        rest = np.flatnonzero(~plain)
        for i, ids in zip(rest, self.encode([data[a:b].tobytes().decode() for a, b in zip(starts[rest], ends[rest])])):
            own[i], counts[i] = np.array(ids, np.uint32), len(ids)
        row = np.flatnonzero(plain)
        size = (ends - starts)[row]
        text = data[ranges(starts[row], size)].tobytes().decode()
        ids = np.array(self.encode([text])[0] if text else [], np.uint32)
        until = np.concatenate([[0], np.cumsum(self.size[ids])])
        cuts = np.searchsorted(until, np.concatenate([[0], np.cumsum(size)]))
        if (until[cuts] != np.concatenate([[0], np.cumsum(size)])).any():
            raise ValueError("the tokenizer joins visible characters with white space after them")
        counts[row] = np.diff(cuts)
        out = np.empty(counts.sum(), np.uint32)
        where = np.repeat(plain, counts)
        out[where] = ids
        if len(rest):
            out[~where] = np.concatenate([own[i] for i in rest])
        return out, counts

    def __call__(self, texts: Texts) -> Iterator[np.ndarray]:
        """The ids of every text in turn."""
        data, offsets = texts.data, texts.offsets
        before = np.zeros(len(data), bool)  # a visible character of ASCII or Latin-1 stands before
        before[1:] = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
        before[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80)
        cut = before & ~NOT_SPACE[data]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        low = 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + SLICE, "right")))
            for part in self._slice(data[starts[low]:ends[high - 1]], starts[low:high] - starts[low], ends[low:high] - starts[low]):
                ids.append(part[0])
                counts.append(part[1])
            low = high
        flat = np.concatenate(ids)
        at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.searchsorted(starts, offsets)]
        return (flat[a:b] for a, b in zip(at, at[1:]))

    def _slice(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hashes, first, number = np.unique(Words(Texts.of(data, np.array([0, len(data)])), NOT_SPACE, False).hash_of(starts, ends),
                                          return_index=True, return_inverse=True)
        size, same = ends - starts, first[number]
        if (size != size[same]).any() or (data != data[np.arange(len(data)) - np.repeat(starts - starts[same], size)]).any():
            yield self.chunk_ids(data, starts, ends)  # two chunks share a hash: tokenise every one
            return
        starts, size = starts[first], size[first]
        place = self.memory.find(hashes, data, starts, size)
        known, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        ids, count = self.chunk_ids(data, starts[new], starts[new] + size[new])
        counts, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        counts[new], at[new] = count, np.cumsum(count) - count
        counts[known], at[known] = self.memory.count[place[known]], self.memory.first[place[known]] + len(ids)
        every = np.concatenate([ids, self.memory.ids])
        self.memory.add(hashes[new], data, starts[new], size[new], ids, count)
        yield every[ranges(at[number], counts[number])], counts[number]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, slot[, ids]): the ids of every text and ``end_id``, cut every ``sequence`` ids.

    ``path`` names the tokeniser's file, which every executor must have.  ``slot`` is a random number, ``ids``
    the ids as little-endian unsigned 32-bit numbers.
    """
    def run(batches):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, done = encoder(path), 0
        task = mix(np.array([TaskContext.get().partitionId() + 1], U))
        for piece in pieces(batches, limit=SLICE):
            names, rows = piece.column("doc_id"), ([], [], [], [], [], [])
            for i, ids in enumerate(encode(Texts(piece.column("text")))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for start in range(0, len(ids), sequence):
                    part = ids[start:start + sequence].tobytes()
                    for column, value in zip(rows, (i, start, len(part) // 4, zlib.crc32(part), len(ids), part if keep_ids else None)):
                        column.append(value)
            slot = mix(task + np.arange(done, done + len(rows[0]), dtype=U)) >> U(1)
            done += len(rows[0])
            columns = [names.take(pa.array(rows[0], pa.int64())), *[pa.array(c, pa.int64()) for c in rows[1:5]], pa.array(slot.view(np.int64))]
            if keep_ids:
                columns.append(pa.array(rows[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot", "ids"][:len(columns)])
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, slot long" + (", ids binary" if keep_ids else ""))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of every size, longest first; equal sizes in their order."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)  # node i has the children 2 i and 2 i + 1; the leaves are the bins
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left > right else right
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def packed(parts: DataFrame, capacity: int = SEQUENCE, group: int = GROUP, length: str = "length", slot: str = "slot") -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; no length may be above ``capacity``.

    ``parts`` should be a table that can be read again: its rows are counted first.
    """
    groups = max(1, -(-parts.count() // group))
    own = free_name([*parts.columns, "sequence_id", "offset"], "group")
    names = [c for c in parts.columns if c.lower() not in ("sequence_id", "offset")]
    grouped = parts.select(*[F.col(f"`{c}`") for c in names], F.pmod(F.col(slot), F.lit(groups)).cast("long").alias(own))

    def run(batches):
        for table in _whole_groups(batches, [own]):
            number = table.column(own).to_numpy()
            bins, offsets = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            for rows in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                bins[rows], offsets[rows] = first_fit_decreasing(table.column(length).to_numpy()[rows], capacity)
            out = table.drop_columns([own]).append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offsets))
            yield from out.to_batches()
    schema = StructType([f for f in grouped.schema.fields if f.name != own]).add("sequence_id", LongType()).add("offset", LongType())
    return grouped.repartition(own).sortWithinPartitions(own, slot).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP, keep_ids: bool = False,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of all texts (``token_pieces``) with ``sequence_id`` and ``offset``."""
    return packed(written(token_pieces(docs, path, sequence, end_id, keep_ids, text, doc_id), "pieces"), sequence, group)
