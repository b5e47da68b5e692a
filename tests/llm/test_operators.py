"""Operators against brute force, and their defined results on odd rows."""

import collections
import hashlib
import html
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import (chosen_path, components, deobfuscate, importance_resample, kneser_ney, language_bits, personal_data, quality_trees,
                           source_mix, style_tree, wu_manber)
from gradeloom.llm.frames import NOT_SPACE, Texts
from gradeloom.llm.queries import CHECKS, QUERIES
from tests.llm.conftest import ODD, SCHEMA
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def documents(shared):
    return {r.doc_id: r for r in shared.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_against_sql(shared, name):
    ok, note = compare(QUERIES[name], CHECKS[name], shared, SF, duck(SF))
    assert ok, note


def test_pieces_hold_whole_words():
    texts = Texts(pa.array(["a b", None, "", "b c  a", "a b"]).slice(0, 5))
    words = texts.words(NOT_SPACE)
    assert words.counts.tolist() == [2, 0, 0, 2, 2]
    assert words.hashes[0] == words.hashes[3] == words.hashes[4] and words.hashes[1] == words.hashes[5] != words.hashes[2]


# --- 1 ---

def plain_spans(text):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)]
    found = [(m.start(), k, m.end()) for k, (_, p, fits) in enumerate(rules) for m in re.finditer(p, text) if fits(m.group())]
    return [(rules[k][0], a, b) for a, k, b in sorted(found)]


def test_base_spans_by_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "@", ".", "x.y@z", "é", " ", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+", "12", "-", "\n", "a", "0001.2.3.4.5.6"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
        assert [(personal_data.KINDS[k], points[a], points[b]) for a, k, b in personal_data.base_spans(text.encode())] == plain_spans(text), text


def test_personal_query(shared):
    docs = documents(shared)
    for r in QUERIES["op1_personal_data"](shared, SF).collect():
        want = plain_spans(docs[r.doc_id].text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in personal_data.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_field_adds_and_masks(shared):
    field = personal_data.train(personal_data.labelled_table(shared))
    text = "é see 988-555-2485 or jo.k (at) site.example.net, since 2021-03-04 12:30:11 in 1.2.3 and 12 of 45 to a@b.example"
    docs = shared.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data.masked(docs, field).collect()}
    assert rows[1].text == "é see [PHONE] or [EMAIL], since 2021-03-04 12:30:11 in 1.2.3 and 12 of 45 to [EMAIL]"
    assert rows[2].text is None and rows[3].text == ""


def test_viterbi_by_all_paths():
    rng = np.random.default_rng(1)
    k = len(personal_data.LABELS)
    field = personal_data.Field({}, np.zeros((1, k)), rng.normal(size=(k, k)) + personal_data._forbidden())
    score = rng.normal(size=(4, 3, k))
    import itertools
    for chain, got in zip(score, personal_data.viterbi(field, score)):
        def value(path, chain=chain):
            steps = [0, *path, 0]
            return sum(chain[i, p] for i, p in enumerate(path)) + sum(field.step[a, b] for a, b in zip(steps, steps[1:]))
        assert tuple(got) == max(itertools.product(range(k), repeat=3), key=value)


# --- 2, 3 ---

def test_kth_largest(shared):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 0.5, -3.0]) for _ in range(3000)]
    df = shared.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 700, 1500, 3000):
        assert importance_resample.kth_largest(df, "v", k, bins=8, last=20) == sorted(values, reverse=True)[k - 1]


def test_resample_by_brute_force(shared):
    docs, labels = documents(shared), {r.doc_id: r.quality for r in shared.read.parquet(f"{SF}/labels.parquet").collect()}

    def grams(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0D]+", w)
        return [*w, *zip(w, w[1:])]
    n = importance_resample.BUCKETS
    bucket: dict = {}
    texts = [r.text or "" for r in docs.values()]
    for text in texts:
        owner, b = importance_resample.buckets_of(Texts(pa.array([text])))
        assert len(b) == len(grams(text))
        for g, x in zip(grams(text), b):
            assert bucket.setdefault(g, x) == x
    raw, target = np.zeros(n), np.zeros(n)
    for r in docs.values():
        for g in grams(r.text):
            raw[bucket[g]] += 1
            target[bucket[g]] += labels.get(r.doc_id) == 1
    p = (raw + 0.5) / (raw.sum() + 0.5 * n)
    ratio = np.log((target + 10 * n * p) / (target.sum() + 10 * n) / p)
    rows = QUERIES["op2_importance_resample"](shared, SF).collect()
    for r in rows:
        assert r.log_ratio == pytest.approx(sum(ratio[bucket[g]] for g in grams(docs[r.doc_id].text)), abs=1e-6)
    top = sorted((r.gumbel_key for r in rows), reverse=True)[round(importance_resample.FRACTION * len(rows)) - 1]
    assert all(r.kept == (r.gumbel_key >= top) for r in rows)


def test_quality_statistics(shared):
    docs, labels = documents(shared), {r.doc_id: r.quality for r in shared.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in QUERIES["op3_quality_rules"](shared, SF).collect():
        text = docs[r.doc_id].text or ""
        w = re.findall("[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)
        if r.doc_id in labels:
            right.append(r.kept == (labels[r.doc_id] == 1))
    assert np.mean(right) > 0.9


def test_trees_keep_directions_and_fit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] + 0.7 * np.sin(3 * x[:, 1]) + rng.normal(size=1500) * 0.3 > 0).astype(float)
    forest = quality_trees.grow(x, y, [1, 0, -1], trees=25)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    for j, sign in ((0, 1), (2, -1)):
        z = np.repeat(rng.normal(size=(40, 3)), 60, axis=0)
        z[:, j] = np.tile(np.linspace(-3, 3, 60), 40)
        steps = np.diff(forest.score(z).reshape(40, 60), axis=1)
        assert (sign * steps >= -1e-12).all()


# --- 4 ---

def test_mix_of_odd_sources(shared, odd, empty):
    rows = source_mix.mixed(odd).select("doc_id", "source", "size", "source_size", "target", "copies", "rate").collect()
    assert len(rows) == len(ODD)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    total, weight = sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2, 3)))
    level = sorted({2 * n / weight[s] for s, n in sizes.items()} | {0})
    def filled(t):
        return sum(min(2 * n, t * weight[s]) for s, n in sizes.items())
    low, high = 0.0, max(level)
    for _ in range(200):
        low, high = ((low + high) / 2, high) if filled((low + high) / 2) < 1.5 * total else (low, (low + high) / 2)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(min(2 * sizes[r.source], high * weight[r.source]), abs=1e-6)
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.copies <= 2
    assert source_mix.mixed(empty).count() == 0
    assert source_mix.repeated(source_mix.mixed(odd)).count() == sum(r.copies for r in rows)


# --- 5 ---

def test_windows_of_odd_rows(shared, odd, empty):
    items = shared.createDataFrame([(10, "Beta gamma, DELTA epsilon zeta eta theta iota kappa lambda nothing"), (11, "ONE"), (12, None), (13, ""), (14, "one"), (None, "one")], "item_id long, text string")
    found = wu_manber.find_items(odd, items).select("doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "hit_spans").collect()
    by = {(r.doc_id, r.text): r for r in found}
    assert len(found) == len(ODD)
    assert by[1, ODD[0][1]].n_hit == 10 and by[1, ODD[0][1]].hit_spans == [[1, 11]]
    assert by[5, "one"].n_items == 2 and by[5, "one"].items_sha256 == hashlib.sha256(b"11,14").hexdigest()
    assert by[2, None].n_words == 0 and by[2, None].n_hit == 0
    assert wu_manber.find_items(empty, items).count() == 0
    none = wu_manber.find_items(odd, items.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == len(ODD)


def test_items_without_id_hit(shared):
    docs = shared.createDataFrame([(1, "all of alpha beta here"), (2, "gamma delta"), (3, "nothing")], "doc_id long, text string")
    items = shared.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), (7, "gamma delta")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in wu_manber.find_items(docs, items).collect()}
    none, seven = (hashlib.sha256(b).hexdigest() for b in (b"", b"7"))
    assert got == {1: (2, 0, True, none), 2: (2, 1, True, seven), 3: (0, 0, False, none)}


def test_passes_agree(shared):
    docs, items = (shared.read.parquet(f"{SF}/{t}.parquet").select(k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    columns = ["doc_id", "n_hit", "n_items", "items_sha256"]
    one, many = (sorted(map(tuple, wu_manber.find_items(docs, items, pass_windows=n).select(columns).collect())) for n in (10 ** 6, 300))
    assert one == many and any(r[1] for r in one)


# --- 6 ---

def test_scores_by_brute_force(shared):
    docs = documents(shared)
    tokens = {d: re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")) + ["</s>"] for d, r in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    one, two = collections.Counter(), collections.Counter()
    for d, t in tokens.items():
        if not held[d]:
            one.update(t)
            two.update(zip(["<s>", *t], t))
    total, distinct = sum(one.values()), len(one)
    left, context, kinds = collections.Counter(w for _, w in two), collections.Counter(), collections.defaultdict(collections.Counter)
    for (a, _), n in two.items():
        context[a] += n
        kinds[a][min(n, 3)] += 1

    def discounts(values):
        n = collections.Counter(values)
        y = n[1] / (n[1] + 2 * n[2])
        return {0: 0, **{k: min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3)}}
    d2, d1, pairs = discounts(two.values()), discounts(left.values()), len(two)
    rest = sum(d1[min(n, 3)] for n in left.values()) / pairs

    def p(a, w):
        low = (left[w] - d1[min(left[w], 3)]) / pairs + rest / (distinct + 1)
        if not context[a]:
            return low
        n = two[a, w]
        return (n - d2[min(n, 3)]) / context[a] + sum(d2[k] * m for k, m in kinds[a].items()) / context[a] * low
    for r in QUERIES["op6_text_score"](shared, SF).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in one for w in t), total, held[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (total + distinct + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t)))


def test_probabilities_sum_to_one(shared):
    train = shared.createDataFrame([("a b c a b",), ("b b a",), ("c",)], "text string")
    model = kneser_ney.count_model(train, shards=3)
    words = shared.createDataFrame([(w,) for w in ("a", "b", "c", "", "unseen")], "text string").select("text")
    hashes = {}
    for r in words.collect():
        token, _ = kneser_ney.tokens(pa.array([r.text]))
        hashes[r.text] = token[0]
    for context in ("a", "b", "c", "unseen"):
        log, _ = kneser_ney.look_up(model, np.full(5, hashes[context]), np.array(list(hashes.values())))
        assert (10 ** log).sum() == pytest.approx(1)


def test_a_missing_file_is_an_error(shared):
    train = shared.createDataFrame([("a b c a b",), ("b b a",)], "text string")
    for part in ("pairs", "left"):
        model = kneser_ney.count_model(train, shards=2)
        token, counts = kneser_ney.tokens(pa.array(["a b c"]))
        kneser_ney.look_up(model, kneser_ney.contexts(token, counts), token)
        kneser_ney._load.cache_clear()
        for name in os.listdir(model.folder):
            if name.startswith(part):
                os.rename(f"{model.folder}/{name}", f"{model.folder}/gone-{name}")
        with pytest.raises(FileNotFoundError):
            kneser_ney.look_up(model, kneser_ney.contexts(token, counts), token)
        with pytest.raises(Exception, match="No such file"):
            kneser_ney.score(train, model).collect()
    empty = kneser_ney.count_model(train.limit(0), shards=2)  # a shard without text has no file, and none is asked for
    assert empty.pair_files == empty.left_files == frozenset() and [r.score for r in kneser_ney.score(train, empty).collect()] == [0.0, 0.0]


def test_counts_that_32_bits_do_not_hold(shared, monkeypatch):
    train = shared.createDataFrame([("a b " * 40,), ("b a c",)], "text string")
    want = [r.score for r in kneser_ney.score(train, kneser_ney.count_model(train, shards=2)).collect()]
    monkeypatch.setattr(kneser_ney, "WIDE", 5)
    kneser_ney._load.cache_clear()
    model = kneser_ney.count_model(train, shards=2)
    token, counts = kneser_ney.tokens(pa.array([r.text for r in train.collect()]))
    log, _ = kneser_ney.look_up(model, kneser_ney.contexts(token, counts), token)
    assert np.add.reduceat(log, np.cumsum(counts) - counts).tolist() == pytest.approx(want)


def test_spread_contexts_agree(shared, monkeypatch):
    docs = shared.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(kneser_ney, "HOT_SAMPLE", 1)
    one = {r.doc_id: r.score for r in kneser_ney.score(docs, kneser_ney.count_model(docs, shards=16)).collect()}
    monkeypatch.setattr(kneser_ney, "HOT_SAMPLE", 1 << 30)
    two = {r.doc_id: r.score for r in kneser_ney.score(docs, kneser_ney.count_model(docs, shards=2)).collect()}
    assert one.keys() == two.keys() and all(one[d] == pytest.approx(two[d]) for d in one)


# --- 7 ---

def test_restores_disguises(shared):
    docs = shared.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    restorer = deobfuscate.Restorer(deobfuscate.letter_model(docs))
    text = "you 1d10t and stup!d m0r0n, i d i o t here s.c.u.m p@thetic tr4sh end. THE!! word$$$ 2024 plain"
    _, found = restorer.extra(Texts(pa.array([text])).words(NOT_SPACE))
    assert {"idiot", "stupid", "moron", "scum", "pathetic", "trash"} <= set(found)
    assert not {"end", "the", "word", "plain"} & set(found)


def test_restores_tokens_of_any_length_and_letters(shared):
    docs = shared.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    restorer = deobfuscate.Restorer(deobfuscate.letter_model(docs))

    def found(text):
        return restorer.extra(Texts(pa.array([text])).words(NOT_SPACE))[1]
    for token, word in (("1d107", "idiot"), ("1053r", "loser"), ("10$3r", "loser"), ("s" + "t" + "u" * 60 + "pid", "stupid"), ("-----------".join("stupid"), "stupid"),
                        ("i.d.!.o.t", "idiot"), ("m.o.r.@.n", "moran"), ("id111ot", "idiot"), ("l000ser", "loser"), ("!d10t", "idiot"), ("tr\u20acsh", "tresh")):
        assert word in found(f"so {token} it is"), (token, found(token))
    run = found(" ".join("youaresuchan1d10tandalsoabigl0serandmanyotherthingsthatwewillnotname"))
    assert {w[:5] for w in run} >= {"idiot", "loser"}
    assert restorer.word("ab1" * 40_000)


def test_toxicity_held_out(shared):
    labels = {r.doc_id: r.toxic for r in shared.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_toxicity"](shared, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


# --- 8 ---

def brute_classes(texts, similarity=0.8):
    sets = [frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]) if w else None for w in ((t or "").encode().split() for t in texts)]
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = [0] * len(distinct)
    for i, a in enumerate(distinct):
        for j in range(i):
            both = len(a & distinct[j])
            if both >= similarity * (len(a) + len(distinct[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    place = {s: i for i, s in enumerate(distinct)}
    return [(None, 0) if s is None else (root(place[s]), links[place[s]]) for s in sets]


def near_texts(seed, groups=12, size=15):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randrange(30, 120))
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return out + ["short text", "short text", "one", "", None]


@pytest.mark.parametrize(("limit", "block"), [(256, 512), (4, 6)])
def test_classes_by_brute_force(shared, monkeypatch, limit, block):
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", block)
    texts = near_texts(limit)
    docs = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in chosen_path.near_classes(docs, limit=limit).collect()}
    want = brute_classes(texts)
    members = collections.defaultdict(list)
    for i, (c, _) in enumerate(want):
        members[i if c is None else ("c", c)].append(i)
    for m in members.values():
        for i in m:
            assert (got[i].class_id, got[i].n_links) == (min(m), want[i][1])
    kept = {r.doc_id for r in chosen_path.one_of_each(docs, limit=limit).collect()}
    assert kept == {min(m) for m in members.values()}


def test_classes_of_odd_rows(shared, odd, empty):
    rows = chosen_path.near_classes(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.class_id for r in rows if r.doc_id == 1} == {1} and {r.n_copies for r in rows if r.doc_id == 1} == {2}
    kept = chosen_path.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert chosen_path.near_classes(empty).count() == 0 and chosen_path.one_of_each(empty).count() == 0


def test_components(shared):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 340)] + [(400 + i, 401 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components.components(shared.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


# --- 9 ---

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>menu</nav><div id="cookie-notice">we use</div><main><article class="post"><h1>Head &amp; more</h1>
<p>One<br>two <a href=x>link</a> three<p>Four <i>five</i>&nbsp;six<ul><li>a<li>b</ul><aside>side</aside><form><input>f</form><!-- c --><script>var a="<p>x</p>"</script>
<table><tr><td>1<td>2</tr></table><div class="share-buttons">share</div><div class="cookiebar">c</div><blockquote>q</blockquote>tail</article><section class="comments"><article class="comment">bad</article></section></main><footer>f</footer></body></html>"""


def test_page_blocks():
    assert style_tree.blocks(style_tree.parse(PAGE), set()) == ["Head & more", "One two link three", "Four five six", "a", "b", "1", "2", "q", "tail"]
    assert style_tree.blocks(style_tree.parse("<div>plain <b>x</b> &lt;b&gt; 3 < 4 & 5</div>text"), set()) == ["plain x <b> 3 < 4 & 5", "text"]


@pytest.mark.parametrize("part", ['<h2 id="search">kept</h2>', '<h2 id="related-work">kept</h2>', '<section id="related-work"><p>kept</p></section>',
                                  '<div class="section-header"><h2>kept</h2></div>', '<p class="form-factor">kept</p>', '<p class="notice">kept</p>',
                                  '<p><math><mi>kept</mi></math></p>', '<div class="widget"><p>kept</p></div>', '<div class="cookies-recipe"><p>kept</p></div>'])
def test_names_leave_article_text(part):
    page = style_tree.parse(f'<body><article><h1>a</h1>{part}<div class="comments">no</div><p>b</p></article><div class="site-footer">no</div></body>')
    assert style_tree.blocks(page, set()) == ["a", "kept", "b"]
    if "widget" not in part:
        plain = style_tree.parse(f'<body><div class="x">{part}</div><div id="comments">no</div><div class="site-footer">no</div><ul class="nav"><li>no</ul></body>')
        assert style_tree.blocks(plain, set()) == ["kept"]


@pytest.mark.parametrize("part,want", [
    ('<p>See <a href="/hidden-costs">the report</a> now</p>', "See the report now"), ('<p title="a hidden gem">Text</p>', "Text"), ('<p data-hidden="false">Text</p>', "Text"),
    ('<div data-role="ad x">Text</div>', "Text"), ("<p data-class='comments' alt=hidden>Text</p>", "Text"), ("<header><h1>Text</h1></header>", "Text"),
    ('<p style="display: none">no</p><p>Text</p>', "Text"), ('<p hidden>no</p><p>Text</p>', "Text"), ('<p a="x>y" hidden=hidden>no</p><p>Text</p>', "Text")])
def test_attributes_are_read_whole(part, want):
    assert style_tree.blocks(style_tree.parse(f"<body><header>no</header><article>{part}</article></body>"), set()) == [want]


def test_any_depth():
    deep = "<div>" * 5000 + "<p>kept</p><nav><ul><li>no</ul></nav><section class='ad'>no</section>" + "</div>" * 5000
    root = style_tree.parse(f"<body>{deep}<p>tail</p></body>")
    assert style_tree.blocks(root, set()) == ["kept", "tail"]
    assert len(style_tree.contents(root)) == sum(1 for _ in style_tree.walk(root))


def test_contents_by_plain_sequences():
    rng = random.Random(12)
    parts = ["<div>", "</div>", "<p>", "a", "b", "<b>", "</b>", "<nav>", "</nav>", "<ul><li>", "</ul>"]
    for _ in range(300):
        root = style_tree.parse("".join(rng.choice(parts) for _ in range(20)))
        found = style_tree.contents(root)

        def sequence(node):
            return [*(() if node.dropped else (t for _, t in node.text)), *(t for c in node.children for t in sequence(c))]
        groups = {}
        for node in style_tree.walk(root):
            groups.setdefault(tuple(sequence(node)), set()).add(found[id(node)])
        assert all(len(h) == 1 for h in groups.values()) and len({h for g in groups.values() for h in g}) == len(groups)


def test_importance_by_plain_entropies(shared):
    rows = [("h", node, layout, content, page) for node, pages in (("n1", 6), ("n2", 1), ("n3", 5)) for page in range(pages)
            for layout, content in [(page % 2, page % 3 if node == "n1" else 0)]]
    frame = shared.createDataFrame([(h, n, l, c) for h, n, l, c, _ in rows], "host string, node string, layout long, content long")
    counted = frame.groupBy("host", "node", "layout", "content").agg(F.count(F.lit(1)).alias("n"))
    for r in style_tree.importance(counted).collect():
        own = [(l, c) for _, n, l, c, _ in rows if n == r.node]

        def scaled(values):
            n = collections.Counter(values)
            return -sum(k / len(values) * math.log(k / len(values)) for k in n.values()) / math.log(len(values)) if len(values) > 1 else 1.0
        assert r.pages == len(own) and math.isclose(r.importance, max(scaled([l for l, _ in own]), scaled([c for _, c in own])), abs_tol=1e-12)


def test_low_branches_go(shared):
    pages = [(i, f"http://h.example/{i}", f"<body><div class='x'>top {'same' if i % 10 else 'other'}</div><div class='y'><p>Text number {i} here</p></div><div class='z'>always</div></body>") for i in range(40)]
    pages += [(100, None, None), (101, "", ""), (102, "http://alone.example/", "<p>only page</p>")]
    got = {r.page_id: r.text for r in style_tree.extract(shared.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text number {i} here" for i in range(40))
    assert got[100] == got[101] == "" and got[102] == "only page"


def test_pages_query(shared):
    for r in QUERIES["op9_main_text"](shared, SF).join(shared.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br|article)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# --- 10 ---

def test_language_held_out(shared):
    docs = documents(shared)
    rows = [r for r in QUERIES["op10_language"](shared, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_filters_hold_their_grams_and_popcounts_agree(shared):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    model = language_bits.fit(docs, train_texts=40)
    texts = Texts(pa.array(["the and of thing", None, "", "der die und nicht", "Été 123"]))
    text, gram = language_bits.grams_of(texts)
    masks = model.probe(gram)[:, 0]
    total, right = language_bits.popcounts(model, texts)
    for d in range(texts.size):
        for i in range(len(model.languages)):
            hits = int(((masks[text == d] >> np.uint64(i)) & np.uint64(1)).sum())
            f = model.false_rate[i]
            assert total[d] == (text == d).sum() and right[d, i] == pytest.approx(max((hits - total[d] * f) / (1 - f), 0))
    assert gram[text == 4].tolist() == [int.from_bytes(g, "big") for g in ("été".encode()[k:k + 4] for k in range(2))] + [int.from_bytes("té ".encode(), "big")]


# --- odd rows, for the operators that only add columns ---

def test_odd_rows(shared, odd, empty):
    labels = shared.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    field = personal_data.train(personal_data.labelled_table(shared))
    steps = {
        "personal": lambda d: personal_data.find_personal(d, field),
        "masked": lambda d: personal_data.masked(d, field),
        "quality": lambda d: quality_trees.judge(d, quality_trees.train(d, labels)),
        "resample": lambda d: importance_resample.resampled(d, importance_resample.log_ratios(d, labels)),
        "score": lambda d: kneser_ney.score(d, kneser_ney.count_model(d, shards=2)),
        "toxic": lambda d: deobfuscate.score(d, deobfuscate.train(d, labels)),
        "language": lambda d: language_bits.identify(d, language_bits.fit(d)),
        "pages": lambda d: style_tree.extract(d, "source", "text", "main"),
    }
    for name, step in steps.items():
        out = step(odd)
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        assert out.count() == len(ODD) and len(out.collect()) == len(ODD), name
        assert len(step(empty).collect()) == 0, name
    pred = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in steps["language"](odd).collect()}
    assert pred[2, None] == pred[3, ""] == pred[8, "12345 !!! 678"] == ("und", 0.0)
    assert {r.kept for r in importance_resample.resampled(odd, np.zeros(100), fraction=1.0).collect()} == {True}
    assert SCHEMA and os.path.exists(SF)
