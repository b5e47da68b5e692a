"""Packing and CRC resampling against brute force, and their defined results on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeloom.llm import crc_resample, packing
from gradeloom.llm.frames import WORD_BYTES, Texts, numbered
from gradeloom.llm.queries import QUERIES
from tests.llm.conftest import ODD, SCHEMA

SF = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", " ", "\n", "é", " ", " ", "'s", "12", "!", "日本", "\t", "\u0085", "\x1c", "😀", "Word", "  "]


def odd_texts(seed, n=500):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)]


# --- 12 ---

PLAIN = Tokenizer.from_file(TOKENS)


def ids_of(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(monkeypatch):
    plain = Tokenizer.from_file(TOKENS)
    texts = ["", " ", "  a", "a  ", "don't  I'll\n\n\tgo", *odd_texts(4), *[r * 40 for r in odd_texts(5, 20)]]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for size, memory in ((1 << 21, 1 << 23), (50, 1 << 23), (50, 40)):
        monkeypatch.setattr(packing, "SLICE", size)
        monkeypatch.setattr(packing, "MEMORY", memory)
        encode = packing.Encoder(TOKENS)
        for _ in range(2):  # the second time from memory
            assert [i.tolist() for i in encode(Texts(pa.array(texts)))] == want


def test_chunks_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(packing.Words, "hash_of", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two three", "four five", "one", "x  y"]
    encode = packing.Encoder(TOKENS)
    for _ in range(2):
        assert [i.tolist() for i in encode(Texts(pa.array(texts)))] == [ids_of(t) for t in texts]


def test_special_strings_are_ordinary_text():
    (ids,) = packing.encoder(TOKENS)(Texts(pa.array(["a <|endoftext|> b"])))
    assert 50256 not in ids and len(ids) > 3


def test_first_fit_decreasing_by_scan():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 64, 500):
        sizes = np.array([rng.randrange(1, 101) for _ in range(n)], np.int64)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - room[at])
            room[at] -= sizes[i]


def whole(rows, texts):
    """Every id lies in one piece; sequences have no gap and no overlap."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*ids_of(text or ""), packing.END_ID], "<u4")
        want.update((doc_id, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert got == want
    return sum(packing.SEQUENCE - sum(n for _, n in p) for p in bins.values()) / sum(r.length for r in rows)


def test_pack_query(shared):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    assert whole(QUERIES["op12_pack_sequences"](shared, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()]) < 0.02


def test_pack_odd_rows_and_groups(shared, odd, empty):
    long = [(100 + i, "word " * (i * 37 % 3000), "en", "a") for i in range(60)] + [(None, "é" * 30_000, None, None)]
    docs = odd.select("doc_id", "text").union(shared.createDataFrame(long, SCHEMA).select("doc_id", "text"))
    texts = [(r[0], r[1]) for r in [*ODD, *long]]
    whole(packing.pack(docs, TOKENS).collect(), texts)
    parts = packing.pack(docs, TOKENS, group=10, keep_ids=True).collect()
    whole(parts, texts)
    assert len({r.sequence_id >> 32 for r in parts}) > 3
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in parts)
    assert packing.pack(empty, TOKENS).count() == 0


# --- 13 ---

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_buckets(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_crc_matrices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    starts = rng.integers(0, 100_000, 300)
    ends = starts + np.concatenate([rng.integers(0, 40, 280), [1024, 1025, 2047, 2048, 2049, 3072, 90_000, 5000, 1023, 1], rng.integers(1000, 9000, 10)])
    assert crc_resample.crc32s(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_features_of_whole_and_sliced_texts():
    for text in [*odd_texts(6, 200), "", "x" * 5000 + " y z " + "é" * 3000, "ab" * 700 + " cd " * 300]:
        for limit in (1 << 20, 40):
            got, n = [], 0
            for part, _, carried in Texts(pa.array([text])).slices(WORD_BYTES, 2, limit):
                _, bucket, counts = crc_resample.buckets_of(part, carried)
                got += bucket.tolist()
                n += int(counts.sum())
            assert sorted(got) == sorted(plain_buckets(text)) and n == len(words_of(text)), (text[:40], limit)


def plain_resample(docs, items):
    s, t = Counter(b for _, x in docs for b in plain_buckets(x)), Counter(b for x in items for b in plain_buckets(x))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for doc_id, text in docs:
        found = plain_buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, able[:5 * len(able) // 100]


def check_resample(shared, docs, items):
    frame = shared.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, Score string")
    gains = crc_resample.gains(frame, shared.createDataFrame([(x,) for x in items], "text string"))
    rows = crc_resample.drawn(crc_resample.weighed(frame, gains)).collect()
    want, top = plain_resample(docs, items)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in rows) == Counter(want)
    placed = sorted((r.rank, r.doc_id, r.score) for r in rows if r["rank"])
    assert placed == [(i + 1, r[0], r[4]) for i, r in enumerate(top)]


def test_resample_by_brute_force(shared):
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta", "gamma", "x1", "été", "o'clock", "zeta"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(None, docs[3][1] + " tail" * 30)] * 40 + [(7, "same words here " * 9)] * 30 + [(i, None) for i in range(3)] + [(9, "")]
    check_resample(shared, docs, ["alpha beta gamma", "zeta zeta", None, ""])
    check_resample(shared, docs, [])
    check_resample(shared, [], ["alpha"])
    check_resample(shared, [(1, "one two three")], ["one"])


def test_numbered_is_dense(shared):
    rows = numbered(shared.range(1000).select((F.col("id") % 7).alias("at"), "id"), [F.col("at").desc(), F.col("id")], "n").collect()
    assert [r.n for r in sorted(rows, key=lambda r: (-r["at"], r.id))] == list(range(1, 1001))


def test_marks_miss_no_key(shared):
    from gradeloom.llm.frames import maybe_in
    keys = shared.createDataFrame([(i * 7, f"k{i}") for i in range(500)] + [(None, "x")], "a long, b string")
    rows = shared.createDataFrame([(i, f"k{i // 7}") for i in range(7000)] + [(None, "x"), (None, None)], "id long, name string")
    got = maybe_in(rows, F.xxhash64("id", "name"), keys, F.xxhash64("a", "b"), "maybe").collect()
    held = {(r.a, r.b) for r in keys.collect()}
    assert all(r.maybe for r in got if (r.id, r.name) in held) and len(got) == 7002
    assert sum(r.maybe for r in got) < len(held) + 20
    assert not any(r.maybe for r in maybe_in(rows, F.xxhash64("id", "name"), keys.limit(0), F.xxhash64("a", "b"), "maybe").collect())
