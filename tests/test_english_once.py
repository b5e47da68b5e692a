"""Papers are written, normalised and parsed once, behind the exchange that spreads them."""

from gradeloom.catalog import Tables, english as papers
from gradeloom.operators import english
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_nothing_is_parsed_before_the_spread_or_shuffled_after(spark):
    _, _, questions = english.parse_papers(papers.postgraduate_papers(Tables(spark, SF)))
    plan = questions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    spread = plan[plan.index("Exchange"):]
    assert "regexp_replace" not in spread and "Filter (" not in spread


def test_papers_of_one_id_keep_their_own_keys(spark):
    """Two files of one id: each question takes the key printed in its own file."""
    text = "IELTS paper of this year\nReading Comprehension\n1. Who came?\n[A] He [B] She\n2. Who went?\n[A] He [B] She\n1.【答案】"
    rows = spark.createDataFrame([(1, "a.pdf", text + "A\n"), (1, "b.pdf", text + "B\n1.【答案】A\n2.【答案】b")], "doc_id int, file_name string, text string")
    _, _, questions = english.parse_papers(rows)
    got = sorted((r.number, r.answer or "") for r in questions.collect())
    assert got == [("1", "A"), ("1", "A"), ("2", ""), ("2", "B")]


def test_paper_ends_where_its_keys_begin(spark):
    """The text before the first key and before the last heading in front of it, wherever these lie."""
    body = "a\n2.【答案】B\n1.【答案】A\n3.【答案】C"
    cases = [(body, "a\n2.【答案】B"), ("1.【答案】A", ""), ("a 答案解析 b 真题解析\n1.【答案】A", "a 答案解析 b "), ("真题解析\n1.【答案】A", ""),
             ("a\nanswer: 1\n\n answers\n1-A", "a\nanswer: 1\n"), ("plain", "plain")]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", english.without_answers(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
