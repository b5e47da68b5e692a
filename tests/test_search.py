"""Search order, matched fields, terms and notes."""

from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import library, search

OPTION = "array<struct<label:string,text:string>>"


def index(spark):
    rows = [("1", "张三题库", "内科", "心脏", "Ｈｅａｒｔ 问题", "2", [("A", "left ventricle")]), ("2", "阿里题库", "内科", "心脏", "heart", "10", [("A", "x")]),
            ("3", "阿里题库", "内科", "心脏", "heart", "9", [("B", "Aorta")]), ("4", "b", "other", "misc", "nothing", "heart", [("C", "the HEART muscle")])]
    df = spark.createDataFrame(rows, f"id string, bank_name string, group_name string, category string, stem string, source_number string, options {OPTION}")
    return search.search_index(df)


def test_ranking_uses_chinese_and_numeric_order(spark):
    rows = search.search(index(spark), " HEART ").collect()
    # whole stem first (bank, then number), then stem prefix, then number over option
    assert [r.id for r in rows] == ["3", "2", "1", "4"]
    assert [r.score for r in rows] == [220, 220, 205, 80]
    assert rows[3].matched_fields == ["选项", "题号"] and rows[3].matched_option == "C. the HEART muscle"


def test_every_term_must_hit(spark):
    assert search.search(index(spark), "heart aorta").select("id").collect()[0][0] == "3"
    assert search.search(index(spark), "heart zebra").count() == 0
    assert search.search(index(spark), "  ").count() == 0


def test_terms():
    assert X.query_terms("Ａ  a b c d e f g h i") == list("abcdefghi")


def test_note_helpers(spark):
    note = "# 标题\n> 来源：教材\n正文 #心脏 #心脏 #a_b\n> 标签：#x"
    row = spark.range(1).select(X.note_tags(F.lit(note)).alias("t"), X.note_source(F.lit(note), F.lit("f")).alias("s"),
                                X.note_summary(F.lit(note)).alias("m")).first()
    assert row.t == ["心脏", "a_b", "x"] and row.s == "教材" and row.m == "标题 正文 #心脏 #心脏 #ab"


def test_group_order(spark):
    names = F.array(*[F.lit(x) for x in ("未分组题库", "张", "b", "阿")])
    saved = F.array(F.lit("gone"), F.lit("b"), F.lit("b"))
    assert spark.range(1).select(library.reconcile_order(saved, names)).first()[0] == ["b", "阿", "张", "未分组题库"]


def test_blank_segments_longest_number_first(spark):
    row = spark.range(1).select(X.blank_segments(F.lit("a 12 b 2 c"), ["2", "12"]).alias("p"),
                                X.blank_segments(F.lit("a [[2]] b 12"), ["2", "12"]).alias("q")).first()
    assert row.p == ["a ", "12", " b ", "2", " c"] and row.q == ["a ", "[[2]]", " b 12"]
