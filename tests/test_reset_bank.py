"""Bank resets: pairs of learners and questions are not shuffled."""

import os

from gradeloom.operators import sync

FIELDS = {"progress": None, "firstProgress": None, "favorite": "false", "note": None}


def _tables(spark):
    ledger = spark.createDataFrame([(u, q, f, "x", 5, 1) for u in range(6) for q in [0, 7, 299, 300, 310, 999, None] for f in ("progress", "note")],
                                   "user_id int, question_id int, field string, value string, updated_at int, seq int")
    banked = [("b", q) for q in range(310)] + [("c", q) for q in range(300, 320)] + [("b", 7), (None, 999), ("c", None)]  # some in both banks
    resets = [(1, "b", 10), (1, "c", 20), (2, "c", 5), (2, "c", 9), (3, "none", 9), (4, None, 9), (None, "c", 3), (5, "b", 30), (5, "c", 20)]
    return (ledger, spark.createDataFrame(banked, "bank_id string, question_id int"), spark.createDataFrame(resets, "user_id int, bank_id string, reset_at int"))


def test_a_reset_takes_every_question_of_its_banks(spark):
    ledger, questions, resets = _tables(spark)
    hit = {}
    for r in resets.collect():
        for q in questions.collect():
            if r.bank_id and r.bank_id == q.bank_id:
                key = (r.user_id, q.question_id)
                hit[key] = max(hit.get(key, 0), r.reset_at)
    want = [(u, q, f, v, at) for (u, q), at in hit.items() for f, v in FIELDS.items()]
    want += [(r.user_id, r.question_id, r.field, r.value, r.updated_at) for r in ledger.collect() if r.question_id is None or (r.user_id, r.question_id) not in hit]
    assert sorted(map(tuple, sync.reset_bank(ledger, questions, resets).collect()), key=repr) == sorted(want, key=repr)


def test_no_pair_is_shuffled_and_files_stay_small(spark, tmp_path):
    ledger = spark.createDataFrame([], "user_id int, question_id int, field string, value string, updated_at int, seq int")
    questions = spark.range(4000).selectExpr("concat('bank ', id % 2) as bank_id", "id * 7919 as question_id")
    resets = spark.range(400).selectExpr("id as user_id", "concat('bank ', id % 2) as bank_id", "id as reset_at")
    out = sync.reset_bank(ledger.withColumn("user_id", ledger.user_id.cast("long")), questions, resets)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.split("\n")]
    at = max(i for i, line in enumerate(lines) if line.startswith("Generate explode(_questions"))
    join = next(i for i, line in enumerate(lines) if i > at and line.startswith("SortMergeJoin"))
    assert not [line for line in lines[at:join] if line.startswith(("Exchange", "Sort ", "Window", "HashAggregate"))]
    assert "question_id" not in "".join(line for line in lines if line.startswith("Exchange") and "user_id" in line)
    out.write.parquet(f"{tmp_path}/out")
    written = sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 400 * 2000 * 4 and written < 3_200_000
