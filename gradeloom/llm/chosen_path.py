"""Self-join of texts on word shingles by chosen paths.

Every text is the set of its five-word shingles, sketched by minhashes.  A run starts all sets at
one root; a node hands each set on to about 1/similarity children, one per sampled minhash
position and its value, so similar sets keep meeting while others part.  Buckets of at most
``limit`` sets are compared outright; larger ones are split again, down to ``depth``; runs are
repeated until a pair at the threshold is met with probability ``recall``.

The sketch only proposes: sets that agree loosely form candidate clusters, and inside a cluster
every pair of different sets is compared exactly, block by block, so links found by any run are
all verified, and none is emitted as a pair.  Equal sets are one set throughout ("copies").
Large tight buckets are tied to a pivot set first; only sets that the pivot did not take are
compared with the rest, so a huge group of near copies costs a linear step, not a square.

Defined results: null texts and texts without words are alone in their class, with no links;
texts of one to four words have one shingle, all their words; equal texts, repeated rows
included, share a class; a class is named by its smallest id (null if all ids are null);
extra columns stay out of the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.llm.components import components
from gradeloom.llm.frames import NOT_SPACE, U, Texts, Words, free_name, map_pieces, maybe_in, mix, release, written

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
POSITIONS = 64
#: Sketches agreeing on this share of positions are compared exactly: 3.6 deviations below the threshold.
LOOSE = 0.62
DEPTH = 3
#: Steps before buckets are counted: sets that share one line only have mostly parted by then.
FIRST_COUNT = 2
LIMIT = 256
BLOCK_SETS, BLOCK_BYTES = 512, 16 << 20
_SALTS = np.frombuffer(np.random.default_rng(20).bytes(8 * POSITIONS), np.uint32).reshape(2, POSITIONS)


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair meets in a bucket of the last level in one run.

    A node samples one position always and a second one with the probability that makes
    1 / similarity children on average.
    """
    q, more = 1.0, 1 / similarity - 1
    for _ in range(depth):
        q = 1 - (1 - similarity * q) * (1 - more * similarity * q)
    return q


def runs_for(similarity: float, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth))))


def children(path: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the buckets each set moves on to from its node."""
    h = mix(path + U(0xA5A5A5A5))
    first = (h % U(POSITIONS)).astype(np.int64)
    second = ((first + 1 + ((h >> U(16)) % U(POSITIONS - 1)).astype(np.int64)) % POSITIONS)
    both = np.flatnonzero((h >> U(40)).astype(np.float64) / (1 << 24) < 1 / similarity - 1)
    row = np.concatenate([np.arange(len(path)), both])
    position = np.concatenate([first, second[both]])
    value = sketch[row, position].astype(U) * U(POSITIONS) + position.astype(U)
    return row, mix(path[row] * U(0xD6E8FEB86659FD93) + mix(value + U(1)))


class Shingles:
    """Distinct shingle hashes of every text of a piece, in order of (text, hash)."""

    def __init__(self, column, size: int = SHINGLE):
        texts = Texts(column)
        words = Words(texts, NOT_SPACE, False)
        first, h = words.windows(size)
        text = words.text[first]
        for i in np.flatnonzero((words.counts > 0) & (words.counts < size)):
            own = words.hashes[words.first[i]:words.first[i + 1]]
            short = mix((mix(own + np.arange(len(own), dtype=U)) * U(31)).sum(keepdims=True) + U(len(own)))
            text, h = np.append(text, i), np.append(h, short)
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.text, self.hashes = text[fresh], h[fresh]
        self.first = np.searchsorted(self.text, np.arange(texts.size + 1))
        self.counts = np.diff(self.first)
        self.some = np.flatnonzero(self.counts)

    def prints(self) -> list[bytes | None]:
        """128 bits that name each set."""
        out: list[bytes | None] = [None] * len(self.counts)
        if len(self.some):
            at = self.first[:-1][self.some]
            a, b = np.add.reduceat(mix(self.hashes), at), np.bitwise_xor.reduceat(mix(self.hashes ^ U(0x5BD1E995)), at)
            for i, x, y, n in zip(self.some, a, mix(b + self.counts[self.some].astype(U)), self.counts):
                out[i] = x.tobytes() + y.tobytes()
        return out

    def sketches(self) -> np.ndarray:
        """Minhashes of the texts in ``some``."""
        out = np.empty((len(self.some), POSITIONS), np.uint32)
        if len(self.some):
            at, h = self.first[:-1][self.some], (self.hashes >> U(32)).astype(np.uint32)
            for j in range(POSITIONS):
                v = (h ^ _SALTS[0, j]) * (_SALTS[1, j] | np.uint32(1))
                out[:, j] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), at)
        return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, print, shingles, sketch) per row; print and sketch are null for texts without words.

    ``mark`` is Spark's own hash of the text: id and mark name a row, so later steps find texts without sending them.
    """
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        s = Shingles(piece.column("text"), size)
        sketch: list[bytes | None] = [None] * len(s.counts)
        for i, row in zip(s.some, s.sketches()):
            sketch[i] = row.tobytes()
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("mark"), pa.array(s.prints(), pa.binary()), pa.array(s.counts, pa.int64()),
                                           pa.array(sketch, pa.binary())], ["doc_id", "mark", "print", "shingles", "sketch"])
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return map_pieces(plain, run, f"doc_id {kind}, mark long, print binary, shingles long, sketch binary")


def _grid(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component of n nodes."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            break
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``keys`` as tables that never cut a group of equal keys."""
    held: pa.Table | None = None
    for batch in batches:
        here = pa.Table.from_batches([batch])
        here = here if held is None else pa.concat_tables([held, here])
        ids = np.stack([here.column(k).to_numpy() for k in keys])
        cut = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))
        if not len(cut):
            held = here
            continue
        yield here.slice(0, int(cut[-1]) + 1)
        held = here.slice(int(cut[-1]) + 1)
    if held is not None and held.num_rows:
        yield held
    release()


def _loose_edges(rows: DataFrame, loose: float) -> DataFrame:
    """(a, b) ties inside groups of equal (key, part); groups are bounded by two blocks of ``limit`` sets."""
    def run(batches):
        for group in _whole_groups(batches, ["key", "part"]):
            key, part = group.column("key").to_numpy(), group.column("part").to_numpy()
            grid, prints = _grid(group.column("sketch")), group.column("print").to_pylist()
            a, b, step = [], [], 1
            alive = np.arange(len(key))
            while True:
                alive = alive[alive + step < len(key)]
                alive = alive[(key[alive] == key[alive + step]) & (part[alive] == part[alive + step])]
                if not len(alive):
                    break
                close = (grid[alive] == grid[alive + step]).sum(axis=1) >= loose * POSITIONS
                a.append(alive[close])
                b.append(alive[close] + step)
                step += 1
            label = _labels(len(key), np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int))
            tied = np.flatnonzero(label != np.arange(len(key)))
            yield pa.RecordBatch.from_arrays([pa.array([prints[i] for i in tied], pa.binary()),
                                              pa.array([prints[i] for i in label[tied]], pa.binary())], ["a", "b"])
    return (rows.select("key", "part", "print", "sketch").repartition("key", "part").sortWithinPartitions("key", "part")
            .mapInArrow(run, "a binary, b binary"))


def _paths(sets: DataFrame, similarity: float, runs: int | None) -> DataFrame:
    """(key, print): the children of each row's node; with ``runs`` the nodes ``FIRST_COUNT`` steps below the roots of all runs."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            grid, prints = _grid(batch.column("sketch")), batch.column("print")
            if runs is None:
                row, child = children(batch.column("key").to_numpy().view(U), grid, similarity)
            else:
                rows, paths = [], []
                for r in range(runs):
                    row = np.arange(len(grid))
                    path = np.full(len(grid), mix(np.array([r + 1], U))[0], U)
                    for _ in range(FIRST_COUNT):
                        at, path = children(path, grid[row], similarity)
                        row = row[at]
                    rows.append(row)
                    paths.append(path)
                row, child = np.concatenate(rows), np.concatenate(paths)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), prints.take(pa.array(row))], ["key", "print"])
    columns = ["print", "sketch"] if runs else ["key", "print", "sketch"]
    return sets.select(*columns).mapInArrow(run, "key long, print binary")


def candidate_ties(sets: DataFrame, similarity: float, recall: float, depth: int, limit: int, loose: float) -> DataFrame:
    """(a, b): ties between sets (print, sketch) that some run brought together and whose sketches agree."""
    nodes = _paths(sets, similarity, runs_for(similarity, depth, recall))
    ties: DataFrame | None = None

    def add(more: DataFrame) -> None:
        nonlocal ties
        more = written(more, "ties")
        ties = more if ties is None else ties.union(more)

    for level in range(FIRST_COUNT, depth + 1):
        nodes = written(nodes, "nodes")
        buckets = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("pivot")).where("n > 1")
        rows = written(nodes.join(buckets, "key").join(sets, "print"), "buckets")
        add(_loose_edges(rows.where(F.col("n") <= limit).withColumn("part", F.lit(0).cast("long")), loose))
        large = rows.where(F.col("n") > limit)
        if large.isEmpty():
            break
        pivots = sets.select(F.col("print").alias("pivot"), F.col("sketch").alias("pivot_sketch")).join(
            large.select("key", "pivot").distinct(), "pivot")

        def tie(batches):
            for batch in batches:
                same = (_grid(batch.column("sketch")) == _grid(batch.column("pivot_sketch"))).sum(axis=1) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "n", "pivot", "print", "sketch")],
                                                  pa.array(same >= loose * POSITIONS, pa.bool_())], ["key", "n", "pivot", "print", "sketch", "tied"])
        met = written(large.join(pivots.select("key", "pivot_sketch"), "key").select("key", "n", "pivot", "print", "sketch", "pivot_sketch").mapInArrow(
            tie, "key long, n long, pivot binary, print binary, sketch binary, tied boolean"), "pivots")
        add(met.where("tied").select(F.col("print").alias("a"), F.col("pivot").alias("b")))
        open_keys = met.groupBy("key").agg(F.sum(F.when(F.col("tied"), 0).otherwise(1)).alias("free")).where("free > 0")
        left = met.join(open_keys, "key")
        if level < depth:
            nodes = _paths(left, similarity, None).distinct()
            continue
        # The last level: blocks of sets the pivot took (t) and left (f); every pair of blocks but (t, t) is compared.
        t, f = F.ceil((F.col("n") - F.col("free")) / limit), F.ceil(F.col("free") / limit)
        own = F.when(F.col("tied"), f + F.pmod(F.xxhash64("print"), t)).otherwise(F.pmod(F.xxhash64("print"), f))
        other = F.explode(F.when(F.col("tied"), F.sequence(F.lit(0).cast("long"), f - 1)).otherwise(F.sequence(F.lit(0).cast("long"), f + t - 1)))
        parts = left.withColumn("own", own).withColumn("other", other).withColumn(
            "part", F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other"))
        add(_loose_edges(parts, loose))
    return ties


def _exact(batches, similarity: float):
    """Links and ties of the sets in groups of equal (cluster, part)."""
    for table in _whole_groups(batches, ["cluster", "part"]):
        ids = np.stack([table.column(k).to_numpy() for k in ("cluster", "part")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        prints, sets, own, part = (table.column(c).to_pylist() for c in ("print", "hashes", "own", "part"))
        out: tuple[list, list, list] = ([], [], [])
        for low, high in zip(cuts, cuts[1:]):
            seen = {prints[i]: i for i in range(low, high)}  # repeated rows of one set
            rows = sorted(seen.values())
            linked, label = _links([np.frombuffer(sets[i], U) for i in rows], np.array([own[i] for i in rows]),
                                   part[low] // (1 << 31) == part[low] % (1 << 31), similarity)
            out[0].extend(prints[i] for i in rows)
            out[1].extend(int(n) for n in linked)
            out[2].extend(prints[rows[j]] for j in label)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["a", "links", "b"])


def _links(sets: list[np.ndarray], own: np.ndarray, one_block: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set the number of others at the threshold, and the smallest set it is tied to.

    Shingles held by the same sets are merged into one weighted column before the overlaps are
    taken as a matrix product, a bounded number of columns at a time.
    """
    n, size = len(sets), np.array([len(s) for s in sets], float)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    tag = mix(np.arange(1, n + 1, dtype=U))
    pattern = np.zeros(len(values), U)
    np.add.at(pattern, column, tag[owner])
    shared = np.flatnonzero(count > 1)
    _, where, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    number = np.full(len(values), -1)
    number[shared[where]] = np.arange(len(where))
    at = number[column]
    owner, at = owner[at >= 0], at[at >= 0]
    overlap = np.zeros((n, n), np.float64)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, len(where), 2048):
        span = slice(*np.searchsorted(at, [low, low + 2048]))
        held = np.zeros((n, min(2048, len(where) - low)), np.float32)
        held[owner[span], at[span] - low] = 1
        overlap += (held * weight[low:low + held.shape[1]].astype(np.float32)) @ held.T
    linked = overlap >= similarity * (size[:, None] + size[None, :] - overlap) - 1e-9
    np.fill_diagonal(linked, False)
    if not one_block:
        linked &= own[:, None] != own[None, :]
    a, b = np.nonzero(np.triu(linked))
    return linked.sum(axis=1), _labels(n, a, b)


def _classes(docs: DataFrame, text: str, doc_id: str, size: int, similarity: float, recall: float, depth: int, limit: int,
             loose: float) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (print, class_id, n_copies, n_links, kept, own_id, own_mark) of every set."""
    rows = written(fingerprints(docs, text, doc_id, size), "prints")
    sets = written(rows.where("print is not null").groupBy("print").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("own"), F.count(F.lit(1)).alias("n_copies"),
        F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
        .select("print", F.col("own.doc_id").alias("own_id"), F.col("own.mark").alias("own_mark"), "n_copies", "shingles", "sketch"), "sets")
    ties = candidate_ties(sets.select("print", "sketch"), similarity, recall, depth, limit, loose)
    clusters = components(ties)
    members = clusters.join(sets.select("print", "own_id", "own_mark", "shingles"), clusters.node == sets.print).select("print", "own_id", "own_mark", "shingles", "root")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("shingles") * 8 / BLOCK_BYTES)).alias("blocks"))
    members = written(members.join(blocks, "root").select("print", "own_id", "own_mark", F.xxhash64("root").alias("cluster"), "blocks"), "members")

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    # Only the texts that may be members move; the join is planned alike at every size.
    plain = maybe_in(plain, F.xxhash64("doc_id", "mark"), members, F.xxhash64("own_id", "own_mark"), "maybe").where("maybe")
    found = plain.join(members.hint("merge"), plain.doc_id.eqNullSafe(members.own_id) & (plain.mark == members.own_mark)).select("print", "cluster", "blocks", "text")

    def shingle(piece: pa.RecordBatch) -> pa.RecordBatch:
        s = Shingles(piece.column("text"), size)
        ours = np.array([p == q for p, q in zip(s.prints(), piece.column("print").to_pylist())], bool)
        sets_ = [s.hashes[s.first[i]:s.first[i + 1]].tobytes() if ours[i] else None for i in range(len(ours))]
        out = pa.RecordBatch.from_arrays([*[piece.column(c) for c in ("print", "cluster", "blocks")], pa.array(sets_, pa.binary())],
                                         ["print", "cluster", "blocks", "hashes"])
        return out.filter(pa.array(ours))
    whole = map_pieces(found, shingle, "print binary, cluster long, blocks long, hashes binary")
    own = F.pmod(F.xxhash64("print"), F.col("blocks"))
    parts = whole.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cluster", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).alias("part"), "own", "print", "hashes")
    exact = written(parts.repartition("cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(
        lambda batches: _exact(batches, similarity), "a binary, links long, b binary"), "links")
    links = exact.groupBy(F.col("a").alias("print")).agg(F.sum("links").alias("n_links"))
    classes = components(exact).select(F.col("node").alias("print"), "root")

    named = sets.select("print", "own_id", "own_mark", "n_copies").join(links, "print", "left").join(classes, "print", "left").withColumn("root", F.coalesce("root", "print"))
    names = named.groupBy("root").agg(F.min("own_id").alias("class_id"),
                                      F.min_by(F.struct("own_id", "print"), F.struct(F.col("own_id").isNull(), F.col("own_id"), F.col("print"))).alias("first"))
    named = written(named.join(names, "root").select("print", "class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    (F.col("first.print") == F.col("print")).alias("kept"), "own_id", "own_mark"), "classes")
    return rows, named


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL,
                 depth: int = DEPTH, limit: int = LIMIT, loose: float = LOOSE) -> DataFrame:
    """Per row of ``docs``: (doc_id, print, class_id, n_links, n_copies, kept, own_id).

    ``n_links`` counts the other shingle sets at the threshold, ``n_copies`` the rows with this row's
    own set; ``kept`` tells whether the class keeps this row's set, ``own_id`` the id of the row to keep of it.
    """
    rows, named = _classes(docs, text, doc_id, size, similarity, recall, depth, limit, loose)
    return rows.select("doc_id", "print").join(named, "print", "left").select(
        "doc_id", "print", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("kept", F.lit(True)).alias("kept"), F.col("own_id").alias("own_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL,
                depth: int = DEPTH, limit: int = LIMIT, loose: float = LOOSE) -> DataFrame:
    """The rows of ``docs`` with one row per class: the one with the smallest id, all columns as they are.

    Rows without words stay.  Of the texts only those move that may have to go (``maybe_in``); of rows that are equal in
    id and text one is kept.
    """
    rows, named = _classes(docs, text, doc_id, size, similarity, recall, depth, limit, loose)
    kept = named.where("kept").select(F.col("own_id").alias("doc_id"), F.col("own_mark").alias("mark"), F.lit(True).alias("kept"))
    held = rows.where("print is not null").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    judged = held.join(kept.withColumnsRenamed({"doc_id": "kept_id", "mark": "kept_mark"}),
                       F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left")
    key, mark, nth, again, maybe = (free_name(docs.columns, c) for c in ("row_id", "row_mark", "row_nth", "row_again", "row_maybe"))
    odd = written(judged.where("kept is null or times > 1").select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("kept").isNotNull().alias(again)), "gone")
    own = F.xxhash64(text)
    marked = maybe_in(docs, F.xxhash64(F.col(f"`{doc_id}`"), own), odd, F.xxhash64(key, mark), maybe)
    met = marked.where(maybe).join(odd.hint("merge"), F.col(f"`{doc_id}`").eqNullSafe(F.col(key)) & (own == F.col(mark)), "left")
    once = met.where(again).withColumn(nth, F.row_number().over(Window.partitionBy(doc_id, mark).orderBy(F.lit(1)))).where(F.col(nth) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~F.col(maybe)).select(columns).union(met.where(F.col(again).isNull()).select(columns)).union(once.select(columns))
