"""Unanswered questions: pairs of learners and questions are not shuffled."""

from gradeloom.operators import learn


def test_no_pair_is_shuffled(spark):
    enrolled = spark.createDataFrame([(u, "b") for u in range(40)] + [(1, "b"), (2, "other")], "u int, b string")
    questions = spark.createDataFrame([("b", q) for q in range(300)] + [("c", 1000)], "b string, q int")
    answered = spark.createDataFrame([(u, q) for u in range(0, 40, 2) for q in range(u, 300, 7)] + [(0, q) for q in range(300)] + [(3, 1000), (3, 5), (3, 5)], "u int, q int")
    out = learn.unanswered(enrolled, questions, answered, "u", "b", "q").select("u", "b", "q")
    done = {(r.u, r.q) for r in answered.collect()}
    assert sorted(map(tuple, out.collect())) == sorted((u, "b", q) for u in range(40) for q in range(300) if (u, q) not in done)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.split("\n")]
    assert "LeftAnti" not in plan
    at = next(i for i, line in enumerate(lines) if line.startswith("Generate"))
    assert not [line for line in lines[:at] if line.startswith(("Exchange", "Sort", "Window"))]
