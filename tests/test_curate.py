"""Golden cases of blueprints, audits, reconciliation, chunks and recovery."""

from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.text import group_rule_number
from gradeloom.operators import blueprint, chunks, curate, learn, structured

OPTION = "array<struct<label:string,text:string>>"
Q = f"paper string, seq int, source_number string, stem string, options {OPTION}, answer array<string>, answer_source string, question_type string, multiple boolean"


def abcd(labels="ABCD"):
    return [(x, f"{x} 选项") for x in labels]


def test_legacy_blueprint(spark):
    papers = spark.createDataFrame([("p", "1994年考研西综真题_OCR.docx", "A型题 1-92\nB型题 93-118\nC型题 119-138\nX型题 139-160")], "paper string, file_name string, text string")
    row = blueprint.detect_blueprint(papers).first()
    assert row.exam_format == "legacy-c-type" and row.expected == 160 and row.exam_year == 1994
    kind = [s.question_type for s in row.sections if s.start <= 120 <= s.end]
    assert kind == ["C"] and all(s.points is None for s in row.sections)


def test_profile_and_group(spark):
    names = [("2025西综306考研真题", "考研西综306"), ("a1306b", ""), ("小儿呼吸", "儿科学")]
    rows = spark.createDataFrame(names, "n string, g string").select(group_rule_number(F.col("n")).alias("r"), "g").collect()
    assert all([*[n for n, _ in V.GROUP_RULES], ""][r.r] == r.g for r in rows)


def test_full_paper_is_worth_300(spark):
    q = spark.range(1, 166).withColumn("n", F.col("id"))
    assert learn.with_points(q, "n").agg(F.sum("points")).first()[0] == 300


def test_standardize_and_audit(spark):
    missing = {80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 163, 164, 165}
    rows = [("p", n, str(n), f"第 {n} 题", abcd(), ["A", "C"] if n >= 136 else ["B"], None, None, n >= 136) for n in range(1, 166) if n not in missing]
    raw = spark.createDataFrame(rows, Q)
    papers = spark.createDataFrame([("p", "2025年306真题.pdf", "2025年研究生考试（306西医综合）\nA型题 1-115\nB型题 116-135\nX型题 136-165")], "paper string, file_name string, text string")
    plan = blueprint.detect_blueprint(papers)
    std = curate.standardize(raw, plan)
    report = curate.audit(std, raw, plan).first()
    assert report.usable and report.questions == 152 and report.answered == 152
    assert sorted(report.missing) == sorted(missing)
    assert (report.type_a, report.type_b, report.type_c, report.type_x) == (105, 20, 0, 27)
    assert std.where("source_number = '136'").first().multiple


def test_seam_and_reconciliation(spark):
    source = ("[[PAGE 1]]\n" + "窑里的火要烧三天\n" * 1300 + "\n52.能用来编篮子的材料有\n[[PAGE 2]]\nA.柳条\nB.竹篾\n"
              "C.玻璃\nD.藤条\n【答案】ABD\n53.接着一题\nA.一\nB.二\n【答案】B")
    docs = spark.createDataFrame([("p", source)], "paper string, text string")
    seams = chunks.pack_pages(docs, "paper", "text", 7200).where("kind = 'seam'").collect()
    assert len(seams) == 1 and "52.能用来编篮子" in seams[0].chunk and "【答案】ABD" in seams[0].chunk
    q = spark.createDataFrame([("p", 1, "52", "能用来编篮子的材料有", abcd(), [], "", "X", True)], Q)
    fixed = curate.reconcile_by_number(q, curate.explicit_answers(docs)).first()
    assert fixed.answer == ["A", "B", "D"] and fixed.fixed


def test_positional_pairs_need_the_whole_paper(spark):
    q = spark.createDataFrame([("p", i, "?", "s", abcd("AB"), [], "", None, False) for i in range(3)]
                              + [("r", i, "?", "s", abcd("AB"), [], "", None, False) for i in range(2)], Q)
    a = spark.createDataFrame([("p", n, [x]) for n, x in ((7, "A"), (9, "B"), (12, "A"))] + [("r", 1, ["A"])], "paper string, number bigint, found array<string>")
    expected = spark.createDataFrame([("p", 5), ("r", 2)], "paper string, expected int")
    rows = curate.reconcile_by_order(q, a, expected).orderBy("paper", "seq").collect()
    assert [r.answer for r in rows] == [["A"], ["B"], ["A"], [], []]


def test_broken_response(spark):
    content = '''{"questions":[
    {"sourceNumber":"4","stem":"整句","options":[{"label":"A","text":"茶"},{"label":"B","text":"酒"}],"answer":["B"]},
    {"sourceNumber":"5","stem":"缺逗号","options":[{"label":"A","text":"茶"} "answer":["B"]},
    {"sourceNumber":"118","stem":"另一整句","options":[{"label":"A","text":"米"},{"label":"B","text":"面"}],"answer":["A"],"sharedOptionGroup":"118-119"}
  ]}'''
    df = spark.createDataFrame([(1, content)], "doc_id int, content string")
    rows = structured.parse_responses(df, ["doc_id"], F.lit(True), sections=blueprint.sections_literal([("A", 1, 40, 1.5), ("B", 116, 135, 1.5)])).collect()
    assert sorted((r.source_number, r.question_type, r.points) for r in rows) == [("118", "B", 1.5), ("4", "A", 1.5)]


def test_chunks_cover_the_text(spark):
    text = "\n".join(f"line {i} " + "x" * (i * 37 % 90) for i in range(400))
    df = spark.createDataFrame([(text,)], "t string")
    parts = df.select(chunks.overlapping_chunks(F.col("t"), 1500, 100)).first()[0]
    at = 0
    for part in parts:
        found = text.find(part)
        assert 0 <= found <= at and len(part) <= 1500
        at = max(at, found + len(part) + 1)
    assert at >= len(text)


def test_answer_reference_window(spark):
    text = "\n".join(["a"] * 5 + ["参考答案"] + [str(i) for i in range(200)])
    df = spark.createDataFrame([(text,), ("no hint" * 10,)], "t string")
    whole = df.select(chunks.answer_reference(F.col("t"))).collect()
    assert whole[0][0] == text[10:] and whole[1][0] == "no hint" * 10
    out = df.select(chunks.answer_reference(F.col("t"), 50, 90)).collect()
    assert out[0][0].startswith("参考答案\n0\n1") and len(out[0][0]) == 50
    assert out[1][0] == ("no hint" * 10)[-50:]


def test_packing_by_question(spark):
    text = "\n".join(f"{n}. stem {n}\nA. one\nB. two" for n in range(1, 31))
    docs = spark.createDataFrame([("p", text), ("q", "plain words only " * 400)], "paper string, text string")
    rows = chunks.pack_pages(docs, "paper", "text").orderBy("paper", "pos").collect()
    packs = [r.chunk for r in rows if r.paper == "p"]
    assert [p.count("stem") for p in packs] == [14, 14, 2]
    assert "\n".join(packs) == text
    assert {r.kind for r in rows if r.paper == "q"} == {"overlap"}


def test_long_texts_are_cut_in_linear_time(spark):
    import time
    text = "".join(f"line {i} of a long text 题{i}😀\n" for i in range(200_000))  # over 5 MB
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "d int, t string")
    started = time.perf_counter()
    found = {r.d: r.c for r in df.select("d", chunks.overlapping_chunks(F.col("t"), 7200, 360).alias("c")).collect()}
    assert time.perf_counter() - started < 30
    assert found[2] == ["short"] and all(len(c) <= 7200 for c in found[1])
    at = 0
    for piece in found[1]:  # every piece begins at or before the end of the one before it
        start = text.index(piece, max(0, at - 7200))
        assert start <= at
        at = start + len(piece) + 1
    assert at >= len(text)
