"""The pipeline, stage by stage, against brute force over what the stage before kept."""

import collections
import hashlib
import math
import re

import corpus_pipeline
from gradeloom.llm import language_bits, personal_data
from gradeloom.llm.frames import Texts
from tests.llm.conftest import ODD
from tests.llm.test_operators import brute_classes, plain_spans

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keys(rows):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in rows), key=repr)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_stages_by_brute_force(shared):
    import pyarrow as pa
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources"]

    model = language_bits.fit(docs)
    before = docs.collect()
    known = stages["language ID"](shared, docs, SF)
    want = []
    for r in before:
        _, right = language_bits.popcounts(model, Texts(pa.array([r.text])))
        top = sorted(right[0], reverse=True)
        if any(c.isalpha() for c in r.text or "") and top[0] > 0 and top[0] > top[1]:
            want.append(r)
    assert known.columns == COLUMNS and keys(known.collect()) == keys(want) and len(want) > 0.98 * len(before)

    before = known.collect()
    single = stages["n-gram Jaccard join"](shared, known, SF)
    classes = collections.defaultdict(list)
    for r, (c, _) in zip(before, brute_classes([r.text for r in before])):
        classes[r.doc_id if c is None else ("c", c)].append(r)
    want = [min(m, key=lambda r: r.doc_id) for m in classes.values()]
    assert single.columns == COLUMNS and keys(single.collect()) == keys(want) and len(want) < len(before)

    before = single.collect()
    clean = stages["benchmark decontamination"](shared, single, SF)
    windows = set()
    for item in shared.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(item.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))}
    want = [r for r in before if not any(tuple(words(r.text)[i:i + 10]) in windows for i in range(len(words(r.text))))]
    assert clean.columns == COLUMNS and keys(clean.collect()) == keys(want) and 0.5 * len(before) < len(want) < len(before)

    before = {r.doc_id: r for r in clean.collect()}
    masked = stages["PII"](shared, clean, SF)
    after = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == COLUMNS and after.keys() == before.keys()
    for d, r in before.items():
        spans = plain_spans(r.text)
        if not re.search(r"[0-9@]", r.text):
            assert after[d].text == r.text
        assert not plain_spans(after[d].text) and all(after[d].text.count(f"[{k.upper()}]") for k, _, _ in spans)
        assert after[d].n_chars == len(after[d].text)

    mixed = stages["mixing sources"](shared, masked, SF)
    sizes = {d: len(re.findall("[^\x20\x09-\x0D]+", r.text)) for d, r in after.items()}
    per = collections.Counter()
    for d, r in after.items():
        per[r.source] += sizes[d]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(per))}
    low, high = 0.0, 2.0 * max(per.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * weight[s]) for s, n in per.items()) < 1.5 * sum(per.values()) else (low, level)
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    for d, r in after.items():
        rate = min(2 * per[r.source], high * weight[r.source]) / per[r.source]
        u = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert copies[d] == math.floor(rate + 1e-9) + (u < rate - math.floor(rate + 1e-9))


def test_odd_and_empty_rows_pass_through(shared, odd, empty):
    from pyspark.sql import functions as F
    for docs, most in ((odd, len(ODD)), (empty, 0)):
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(shared, docs, SF)
            assert out.columns == docs.columns, name
            assert len(out.collect()) <= most, name
        stage = corpus_pipeline.STAGES[-1][1]
        assert len(stage(shared, docs, SF).collect()) <= 2 * most


def test_run_is_the_stages_in_order(shared):
    from gradeloom.llm.frames import written
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(shared, docs, SF), "step")
    assert sorted(map(str, corpus_pipeline.run(shared, SF).collect())) == sorted(map(str, docs.collect()))
    assert personal_data.KINDS == ("email", "ip", "card", "phone")
