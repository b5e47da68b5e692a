"""Packages, records, texts and the ledger log."""

import json

from pyspark.sql import functions as F

from gradeloom.operators import sync
from gradeloom.sources import packages, tables
from gradeloom.streaming import ledger
from tests.test_sync import SCHEMA


def write(folder, name, value):
    (folder / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_bank_packages(spark, tmp_path):
    question = {"id": "1", "sourceNumber": "1", "category": "c", "stem": "s", "options": [{"label": "A", "text": "t"}], "answer": ["A"]}
    write(tmp_path, "good.json", {"format": "bank", "version": 1, "bank": {"name": "n", "description": "d" * 5000, "questions": [question, {"stem": 5}]}})
    write(tmp_path, "wrong.json", {"format": "other", "version": 1, "bank": {"name": "n", "questions": [question]}})
    write(tmp_path, "empty.json", {"format": "bank", "version": 1, "bank": {"name": "n", "questions": []}})
    good, bad = packages.read_bank_packages(spark, str(tmp_path), ["bank"])
    (row,) = good.collect()
    assert row.name == "n" and len(row.description) == 5000 and len(row.questions) == 1
    assert sorted(r.reason for r in bad.collect()) == ["format", "no_questions"]
    assert packages.explode_questions(good).first().stem == "s"


def test_test_packages_round_trip(spark, tmp_path):
    section = {"id": "reading-a", "kind": "reading", "title": "Text 1", "passage": "A short passage.", "questions": []}
    write(tmp_path, "a.json", {"format": "test-v1", "test": {"name": "Shared", "stage": "moon", "examVariant": "CET-6", "sections": [section]}})
    write(tmp_path, "b.json", {"format": "test-v1", "test": {"name": "", "sections": [section]}})
    good, bad = packages.read_test_packages(spark, str(tmp_path), "test-v1")
    (row,) = good.collect()
    assert (row.name, row.stage, row.sourceFormat, row.sections[0].kind) == ("Shared", "cet", "json", "reading") and bad.count() == 1
    out = str(tmp_path / "out")
    packages.write_test_packages(good, out, "test-v1", "now")
    again, _ = packages.read_test_packages(spark, out, "test-v1")
    assert again.first().sections == row.sections


def test_records_round_trip(spark, tmp_path):
    state = json.dumps({"recordLedger": {"q": {"progress": {"value": "wrong", "updatedAt": 7}}}, "favorites": ["q", ""]})
    rows = spark.createDataFrame([("u", state), ("v", "[1]")], "user_id string, state string")
    path = str(tmp_path / "r")
    packages.write_records(rows, path, "p", "now")
    back, bad = packages.read_records(spark, path)
    assert [r.user_id for r in back.collect()] == ["u"] and [(r.user_id, r.reason) for r in bad.collect()] == [("v", "state")]
    got = {(r.field, r.value, r.updated_at) for r in sync.normalize_ledger(back.withColumn("seq", F.lit(1))).collect()}
    assert got == {("progress", "wrong", 7), ("favorite", "true", 1)}


def test_texts_and_pages(spark, tmp_path):
    (tmp_path / "a.docx.txt").write_text("x\n[[PAGE 2]]\nsecond", encoding="utf-8")
    docs = tables.read_texts(spark, str(tmp_path))
    pages = tables.split_pages(docs, "file_name", "text")
    assert sorted((r.page, r.text.strip()) for r in pages.collect()) == [(0, "x"), (2, "second")]
    ocr = spark.createDataFrame([("a.docx.txt", 2, "second page, longer"), ("a.docx.txt", 0, "")], "file_name string, page int, text string")
    best = tables.choose_page_text(pages, ocr, ["file_name", "page"]).orderBy("page").collect()
    assert [r.text.strip() for r in best] == ["x", "second page, longer"]


def test_ledger_log_replays_and_compacts(spark, tmp_path):
    rows = [("u", "q", "firstProgress", "correct", 3, 1), ("u", "q", "firstProgress", None, 5, 2), ("u", "q", "firstProgress", "wrong", 9, 3),
            ("u", "q", "note", "a", 3, 1), ("u", "q", "note", "b", 4, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    root, packed = str(tmp_path / "log"), str(tmp_path / "packed")
    sink = ledger.append_batch(root)
    sink(df.where("seq in (1, 3)"), 0)
    sink(df.where("seq = 2"), 1)
    sink(df.where("seq = 2"), 1)  # replayed
    want = {tuple(r) for r in sync.merge_ledgers(df).select(*sync.KEY, "value", "updated_at").collect()}
    read = lambda frame: {tuple(r) for r in sync.merge_ledgers(frame).select(*sync.KEY, "value", "updated_at").collect()}
    assert read(ledger.read_log(spark, root)) == want
    assert read(ledger.compact(spark, root, packed)) == want
