"""Bit-sliced search against brute force, and its defined results on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gradeloom.llm import bit_slices
from gradeloom.llm.frames import Texts
from tests.llm.conftest import ODD, SCHEMA

SF = "/root/testdata/sf0.001"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, top=50):
    counts = [(d, Counter(terms_of(x))) for d, x in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, held = len(counts), sum(s for _, _, s in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in counts:
            m = 100 - 50 + 50 * size * n // held
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top])]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


def searched(spark, docs, items, **options):
    frame = spark.createDataFrame([(*d, "own", "own") for d in docs], "doc_id long, text string, KEY string, rank string")
    wanted = spark.createDataFrame([(*i, "own") for i in items], "item_id long, text string, score string")
    return rows_of(bit_slices.search(bit_slices.build_index(frame), frame, wanted, **options))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["été", "Über", "x9"]
    docs = [(i, " ".join(vocabulary[min(202, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.choice([0, 1, 5, 30, 300])))) for i in range(n)]
    return docs, [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(20)]


def test_search_by_brute_force(shared):
    docs, items = corpus(5, 400)
    docs += [(1000 + i, docs[3][1] + " w1 w2 w150 w150") for i in range(150)]  # copies that tie
    docs += [(7, "w100 w101 Über")] * 30 + [(None, "w100 w101")] * 5 + [(2, None), (3, ""), (4, " -- ")]
    items += [(50, "w100 W101 über w100"), (51, None), (52, "unknown"), (53, "")]
    want = plain_search(docs, items)
    assert searched(shared, docs, items) == want
    assert searched(shared, docs, items, first=3, block_items=4, block_terms=30) == want
    assert searched(shared, docs, items, top=3) == plain_search(docs, items, 3)


def test_crowded_signatures_still_give_exact_results(shared, monkeypatch):
    docs, items = corpus(6, 100)
    monkeypatch.setattr(bit_slices, "BITS_PER_KEY", 1)
    assert searched(shared, docs, items, top=5) == plain_search(docs, items, 5)


def test_bounds_are_never_below_scores():
    docs, items = corpus(7, 300)
    texts = Texts(pa.array([x for _, x in docs]))
    owner, h, tf = bit_slices.term_counts(texts)
    sizes = np.bincount(owner, tf, minlength=texts.size).astype(np.int64)
    questions = bit_slices.Questions([x for _, x in items]).weigh({}, int((sizes > 0).sum()), int(sizes.sum()))
    exact = questions.scores(texts)
    seen = tight = 0
    for row in bit_slices._blocks(np.arange(len(docs)), owner, h, tf):
        (keys, own, bits, slices), = bit_slices._each_block([row])
        assert (own == sizes[keys]).all()
        bound = questions.bounds(bits, slices, own)
        assert (bound >= exact[keys].T).all()
        seen, tight = seen + bound.size, tight + int((bound <= exact[keys].T * 1.5 + 1).sum())
    assert seen == len(items) * int((sizes > 0).sum()) and tight > 0.8 * seen


def test_sliced_texts_have_the_same_terms(monkeypatch):
    texts = pa.array(["a b a " * 50, "", "word", None, "é ü " * 30])
    want = [c.tolist() for c in bit_slices.term_counts(Texts(texts))]
    whole = Texts.slices
    monkeypatch.setattr(Texts, "slices", lambda self, table, carry=0, limit=40: whole(self, table, carry, 40))
    assert [c.tolist() for c in bit_slices.term_counts(Texts(texts))] == want


def test_search_odd_and_empty_tables(shared, odd, empty):
    items = shared.createDataFrame([(1, "alpha beta words x"), (2, "12 und Wörds")], "item_id long, text string")
    assert rows_of(bit_slices.search(bit_slices.build_index(odd), odd, items)) == plain_search([r[:2] for r in ODD], [(1, "alpha beta words x"), (2, "12 und Wörds")])
    assert rows_of(bit_slices.search(bit_slices.build_index(empty), empty, items)) == []
    assert rows_of(bit_slices.search(bit_slices.build_index(odd), odd, items.limit(0))) == []
    nothing = shared.createDataFrame([(1, None), (2, "...")], SCHEMA.split(", lang")[0])
    assert rows_of(bit_slices.search(bit_slices.build_index(nothing), nothing, items)) == []


def test_one_long_text_between_short_ones(shared):
    rng = random.Random(2)
    long = " ".join(f"t{rng.randrange(50_000)}" for _ in range(300_000))
    docs = [(1, "t1 t2 t3"), (2, long), (3, "t1")]
    assert searched(shared, docs, [(1, "t1 t2 t49999"), (2, "t7")]) == plain_search(docs, [(1, "t1 t2 t49999"), (2, "t7")])
