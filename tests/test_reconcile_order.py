"""Positional pairing: papers that fit a task move once, larger ones in ranges, with the same result."""

import pytest

from gradeloom import catalog
from gradeloom.operators import curate

catalog.load()
Q = ("paper string, seq int, source_number string, options array<struct<label:string,text:string>>, answer array<string>, answer_source string, "
     "question_type string, multiple boolean")


@pytest.mark.parametrize("large", [1, 3, 10_000])
def test_small_and_large_papers_agree(spark, monkeypatch, large):
    """Even papers of 2 and 6 questions, an answer too many, a question too many, a wrong label, none, answers only, no paper, too many missing."""
    monkeypatch.setattr(curate, "PAPER_IN_TASK", large, raising=False)
    options = [("A", "x"), ("B", "y")]
    asked = [("even", 2), ("six", 6), ("less", 2), ("more", 3), ("wrong", 4), ("none", 1), (None, 2), ("far", 2), ("spare", 5)]
    found = [("even", 2), ("six", 6), ("less", 9), ("more", 2), ("wrong", 4), ("only", 2), (None, 2), ("far", 2), ("spare", 5)]
    q = spark.createDataFrame([(p, i, None if i % 2 else str(i), options, [], "", None, False) for p, n in asked for i in range(n)], Q)
    a = spark.createDataFrame([(p, i, ["D" if p == "wrong" and i == 3 else "AB"[i % 2]]) for p, n in found for i in range(n)], "paper string, number int, found array<string>")
    expected = spark.createDataFrame([(p, 40 if p == "far" else n + 3) for p, n in asked if p not in ("spare", None)], "paper string, expected int")
    got = {(r.paper, r.seq): (r.fixed, r.answer, r.answer_source) for r in curate.reconcile_by_order(q, a, expected).collect()}
    assert sorted(got, key=repr) == sorted(((p, i) for p, n in asked for i in range(n)), key=repr)
    for p, n in asked:  # even places have numbers and come first
        for k, i in enumerate([*range(0, n, 2), *range(1, n, 2)]):
            good = p in ("even", "six", "spare")
            assert got[p, i][:2] == (good, ["AB"[k % 2]] if good else []), (p, i)


def test_lines_move_once_as_numbers(spark):
    plan = catalog.QUERIES["reconcile_positions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-0123456789()*") for line in plan.split("\n")]
    judged = next(i for i, line in enumerate(lines) if line.startswith("Window"))
    numbered = next(i for i, line in enumerate(lines) if line.startswith("Window [row_number()"))
    between = [line for line in lines[judged:numbered] if line.startswith("Exchange")]
    assert not between  # what is numbered is judged in the same task
    assert "options" not in "".join(lines[numbered:numbered + 6]) and "lpad" not in "".join(lines[numbered:numbered + 6])
