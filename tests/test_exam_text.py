"""Golden exam texts."""

from gradeloom.operators.exam_text import parse_questions

INLINE = """一、单选题
1．离太阳最近的行星是：C
A 木星
B 火星
C 水星
D 土星
2．下列哪项不是园艺工具：B
A 铁锹
B 望远镜
C 剪刀
D 水壶
判断题：
1．月亮自己会发光。×
2．竹子属于禾本科。√
四、填空题
1．一年有____个月
六、问答题
1．请说明如何修剪果树。"""

CHAPTERS = """第一章 星空
一、单选题（每题仅一个最佳答案）
1、星座的总数是（ ）
A、56
B、72
C、88
D、96
2、观测流星最好用（ ）
A、肉眼
B、显微镜
C、温度计
D、天平
二、多选题
1、属于行星的是（ ）
A、金星
B、月球
C、火星
D、天狼星
三、判断题
1、北极星永远不动。（ ）
2、彗星有尾巴。（ ）
四、填空题
1、光速约为____
六、问答题
1、简述四季成因。
星空 答案
一、单选题
1、C 2、A
二、多选题
1、AC
三、判断题
1、× 2、√"""

HEADER = """2015N7X.制作陶器时，下列哪些步骤需要加水
A.揉泥
B.拉坯
C.烧窑
D.装箱
答案：AB"""


def parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return parse_questions(df).orderBy("doc_id", "pos").collect()


def test_inline_answers(spark):
    rows = parse(spark, INLINE)
    assert [r.answer for r in rows] == [["C"], ["B"], ["B"], ["A"]]
    assert [o.text for o in rows[2].options] == ["正确", "错误"]
    assert [o.label for o in rows[0].options] == list("ABCD")
    assert rows[0].stem == "离太阳最近的行星是"


def test_chapter_answer_tables(spark):
    rows = parse(spark, CHAPTERS)
    assert [r.answer for r in rows] == [["C"], ["A"], ["A", "C"], ["B"], ["A"]]
    assert rows[2].multiple and not rows[0].multiple
    assert rows[3].stem == "北极星永远不动。"
    assert all("星空" in r.answer_source for r in rows)


def test_exam_header(spark):
    (row,) = parse(spark, HEADER)
    assert row.source_number == "7" and row.question_type == "X"
    assert row.stem == "制作陶器时，下列哪些步骤需要加水"
    assert row.options[0].text == "揉泥" and len(row.options) == 4
    assert row.exam_year == 2015 and row.answer == ["A", "B"]


def test_documents_do_not_mix_and_printed_ten_is_joined(spark):
    text = "一、单选题\n9、甲（ ）\nA、一\nB、二\n10、乙（ ）\nＡ．三\nB、四\n综合 答案\n一、单选题\n9、Ｂ 1 0、A"
    rows = parse(spark, text.replace("综合 答案\n", ""), HEADER, "")
    assert [(r.doc_id, r.source_number, r.answer) for r in rows] == [(0, "9", ["B"]), (0, "10", ["A"]), (1, "7", ["A", "B"])]


def test_duplicate_option_keeps_last_text(spark):
    (row,) = parse(spark, "一、单选题\n1、甲（A）\nA、旧\nB、二\nA、新")
    assert [(o.label, o.text) for o in row.options] == [("A", "新"), ("B", "二")]
