"""Stored search against search over all rows, and what a stored search reads."""

import random

from pyspark.sql import functions as F

from gradeloom.operators import pair_index, search

WORDS = ["alpha", "beta", "al", "a", "题库", "题", "ab 1", "zeta😀", "", "Ünï"]


def texts(spark, n=300):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6)))) for i in range(n)] + [(n, None), (n + 1, "x"), (n + 1, "x")]
    return spark.createDataFrame(rows, "id int, body string").repartition(3)


def test_grams_are_the_pairs_of_a_text(spark):
    for text in ["", "a", "ab", "aab", "题😀b", "xyx yx"]:
        (got,) = spark.range(1).select(pair_index.grams(F.lit(text))).first()
        assert set(got) - {""} == set(text) | {text[i:i + 2] for i in range(len(text) - 1)}
    assert pair_index.term_grams(["abc", "x", ""]) == {"ab", "bc", "x"}


def test_candidates_miss_no_match(spark, tmp_path):
    docs, root = texts(spark), f"file://{tmp_path}"
    pair_index.build(docs, F.col("body"), root, bucket_rows=16, part_rows=64)
    queries = {"one": ["alpha", "beta"], "two": ["题库"], "short": ["a", "题"], "none": ["qq"], "rare": ["zeta😀"], "single": ["x"], "blank": []}
    got = {name: [] for name in queries}
    rows = pair_index.candidates(spark, root, queries, bucket_rows=16, part_rows=64).collect()
    for r in rows:
        for name in r["_queries"]:
            got[name].append(r.id)
    body = [(r.id, r.body or "") for r in docs.collect()]
    for name, terms in queries.items():
        grams = pair_index.term_grams(terms)
        held = sorted(i for i, t in body if grams and all(g in t for g in grams))
        assert sorted(got[name]) == held and {i for i, t in body if terms and all(x in t for x in terms)} <= set(held), name


def test_a_search_reads_postings_of_its_pairs(spark, tmp_path):
    root = f"file://{tmp_path}"
    pair_index.build(texts(spark), F.col("body"), root)
    plan = pair_index.candidates(spark, root, {"q": ["zeta"]})._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram, [et,ta,ze])" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stored_search_equals_search(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["Red bank", "blue"]), "g", rng.choice(["Cat 1", "cat"]), " ".join(rng.choice(WORDS) for _ in range(4)), str(i % 7),
             [("A", rng.choice(WORDS)), ("B", "opt")]) for i in range(200)]
    plain = spark.createDataFrame(rows, "id int, bank_name string, group_name string, category string, stem string, source_number string, options array<struct<label:string,text:string>>")
    index, root = search.search_index(plain, unicode_fold=False), f"file://{tmp_path}"
    search.write_index(index, root)
    for query in ["alpha 1", "red", "opt beta", "题库", "3", "nothing here", ""]:
        assert search.search_stored(spark, root, query, 40, None).collect() == search.search(index, query, 40, None).collect(), query
    many = {"a": "alpha", "b": "red cat", "c": "zz"}
    assert sorted(map(str, search.search_many_stored(spark, root, many, 30).collect())) == sorted(map(str, search.search_many(index, many, 30).collect()))


def test_postings_over_pieces_and_windows(spark, tmp_path, monkeypatch):
    """Long texts, many pieces and NUL characters: the stored lists are those of the column expression, each place once."""
    import pyarrow as pa
    rows = ["ab" * 40, "a", "x\0y\0", "题😀b" * 9, "", "Ünï", "\0"]
    monkeypatch.setattr(pair_index, "PIECE_BYTES", 30)
    monkeypatch.setattr(pair_index, "WINDOW", 7)
    got = {}
    batch = pa.RecordBatch.from_arrays([pa.array(range(30, 30 + len(rows))), pa.array(rows)], ["n", "t"])
    for out in pair_index.postings(iter([batch]), 32):
        for r in out.to_pylist():
            got.setdefault(r["gram"], set()).update(r["bucket"] * 32 + p for p in r["places"])
    want = {}
    for n, text in enumerate(rows, 30):
        for gram in set(text) | {text[i:i + 2] for i in range(len(text) - 1)}:
            want.setdefault(gram, set()).add(n)
    assert got == want


def test_build_moves_lists_and_sorts_no_range(spark, tmp_path):
    root = f"file://{tmp_path}"
    pair_index.build(texts(spark), F.col("body"), root)
    pairs = spark.read.parquet(f"{root}/pairs")
    assert pairs.select("gram", F.input_file_name().alias("f")).distinct().groupBy("gram").count().where("count > 1").count() == 0
    assert pairs.where(F.size("places") > F.size(F.array_distinct("places"))).count() == 0
