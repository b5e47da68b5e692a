"""Shuffles whose number of partitions follows the rows of the input."""

import pytest

from gradeloom import catalog, session
from gradeloom.operators import curate

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cascade_rest", "reconcile_positions"])
def test_partitions_follow_the_rows(spark, monkeypatch, name):
    plain, rows = session.size_shuffles, spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(session, "size_shuffles", lambda spark, n: plain(spark, n, per_task=100))
    df = catalog.QUERIES[name](spark, SF)
    assert f", {-(-rows // 100)}), ENSURE_REQUIREMENTS" in df._jdf.queryExecution().executedPlan().toString()
    session.tune(spark)
    assert spark.conf.get(session.INITIAL, None) is None and spark.conf.get(session.ADVISED) != "16m"


def test_tune_gives_back_what_was_set(spark):
    spark.conf.set(session.INITIAL, "11")
    try:
        session.size_shuffles(spark, 5_000_000)
        session.size_shuffles(spark, 3_000_000)
        assert spark.conf.get(session.INITIAL) == "12"
        session.tune(spark)
        assert spark.conf.get(session.INITIAL) == "11"
    finally:
        spark.conf.unset(session.INITIAL)


def test_an_answer_without_a_question_spoils_its_paper(spark):
    """One paper of each kind: even, an answer too many, a question too many, no answers, answers only; pairs are read from one written table."""
    asked = [("even", 2), ("less", 2), ("more", 3), ("none", 1)]
    found = [("even", 2), ("less", 3), ("more", 2), ("only", 2)]
    options = [("A", "x"), ("B", "y")]
    q = spark.createDataFrame([(p, i, str(i + 1), options, [], "", None, False) for p, n in asked for i in range(n)], "paper string, seq int, source_number string, "
                              "options array<struct<label:string,text:string>>, answer array<string>, answer_source string, question_type string, multiple boolean")
    a = spark.createDataFrame([(p, i, ["A"]) for p, n in found for i in range(n)], "paper string, number int, found array<string>")
    out = curate.reconcile_by_order(q, a, spark.createDataFrame([(p, 5) for p, _ in asked], "paper string, expected int"))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2  # before: the ranges of both sides, twice
    assert sorted((r.paper, r.seq, r.fixed) for r in out.collect()) == [(p, i, p == "even") for p, n in asked for i in range(n)]
