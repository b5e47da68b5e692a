"""Unanswered questions: files of the listed pairs stay small."""

import os

from gradeloom.operators import learn


def test_files_of_pairs_stay_small(spark, tmp_path, monkeypatch):
    enrolled = spark.range(800).selectExpr("id as u", "concat('bank ', id % 4) as b")
    questions = spark.range(8400).selectExpr("concat('bank ', id % 4) as b", "id * 7919 as q")
    answered = spark.range(800).selectExpr("id as u", "explode(array(id % 4, id % 4 + 4, 4 * id + id % 4)) as q").selectExpr("u", "q * 7919 as q")
    monkeypatch.setattr(learn, "BLOCK_QUESTIONS", 20, raising=False)  # 105 blocks of about 20 questions
    out = learn.unanswered(enrolled, questions, answered, "u", "b", "q")
    done = {(r.u, r.q) for r in answered.distinct().collect()}
    asked = {(u, q * 7919) for u in range(800) for q in range(u % 4, 8400, 4)}
    out.write.parquet(f"{tmp_path}/out")
    got = [(r.u, r.q) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == asked - done
    written = sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out"))
    assert written < len(got)  # a byte a pair
