"""English papers and packages written from the tables and read back."""

from pyspark.sql import functions as F

from gradeloom.catalog import Tables, query
from gradeloom.functions.answers import options_text
from gradeloom.operators import english
from gradeloom.session import shared_dir
from gradeloom.sources import packages, tables


def paper_key():
    return F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 900))


PAPER_SQL = "p_brand || '-' || (p_partkey // 900)"


def number():
    return F.col("p_partkey") % 900 + 1


def letter():
    return F.substring(F.lit("ABC"), F.col("p_size") % 3 + 1, F.lit(1))


def _joined(rows, sep):
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["t"]), sep)


def papers(t: Tables):
    """Reading papers of at most 900 questions with a list of keys at the end."""
    ask = F.concat(number(), F.lit(". What is "), "p_name", F.lit(" "), "p_partkey", F.lit("?\n[A] "), "p_type", F.lit(" 【B】 "), "p_brand", F.lit("\nC) size "), "p_size")
    key = F.concat(number(), F.when(F.col("p_size") % 2 == 0, ". ").otherwise("-"), letter())
    rows = t.part.select(paper_key().alias("doc_id"), "p_brand", number().alias("n"), ask.alias("ask"), key.alias("key"))
    per = rows.groupBy("doc_id", "p_brand").agg(_joined(F.struct("n", F.col("ask").alias("t")), "\n").alias("a"), _joined(F.struct("n", F.col("key").alias("t")), " ").alias("k"))
    return per.select("doc_id", F.concat("doc_id", F.lit(".PDF")).alias("file_name"), F.concat(
        "p_brand", F.lit(" IELTS paper\nReading Comprehension "), "p_brand", F.lit("\nDirections: Read the text. Choose the best answer. (20 points)\nThis passage is about "),
        "p_brand", F.lit(".\n\n\n\n\n"), "a", F.lit("\nAnswer key:\n"), "k").alias("text"))


@query("english_questions", f"""SELECT {PAPER_SQL} AS doc_id, (p_partkey % 900 + 1)::VARCHAR AS number, 'What is ' || p_name || ' ' || p_partkey || '?' AS stem,
  'A.' || p_type || '|B.' || p_brand || '|C.size ' || p_size AS options, substr('ABC', p_size % 3 + 1, 1) AS answer FROM part""")
def english_questions(t: Tables):
    _, _, questions = english.parse_papers(papers(t))
    return questions.select("doc_id", "number", "stem", options_text(F.col("options")).alias("options"), "answer")


@query("english_sections", f"""SELECT {PAPER_SQL} AS doc_id, 'section-1' AS section_id, 'reading' AS kind, 'Reading Comprehension ' || p_brand AS title,
  'This passage is about ' || p_brand || '.' AS passage, count(*) AS questions FROM part GROUP BY ALL""")
def english_sections(t: Tables):
    _, sections, _ = english.parse_papers(papers(t))
    return sections.select("doc_id", "section_id", "kind", "title", "passage", "questions")


def _rows(low: int, high: int, make):
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), make), "\n")


def _pick(labels: str, n):
    return F.substring(F.lit(labels), (F.pmod(F.col("p_partkey") + n, F.lit(len(labels))) + 1).cast("int"), F.lit(1))


def postgraduate_papers(t: Tables):
    """A four-part paper for every part of the table: cloze, reading, matching, translation and writing, with keys behind."""
    def lines(*pieces):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    name, brand, kind, size = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    cloze = _rows(1, 20, lambda n: lines(n.cast("string"), " [A] ", kind, " ", n.cast("string"), " [B] ", brand, " [C] c", size, " [D] none"))
    paragraphs = F.array_join(F.transform(F.array(*[F.lit(x) for x in "ABCDEFG"]), lambda x: lines("[", x, "] The ", name, " in place ", x, ".")), "\n")
    tasks = _rows(46, 50, lambda n: lines("(", n.cast("string"), ") The ", name, " was sold ", n.cast("string"), " times."))
    keys = F.concat_ws("\n", _rows(1, 21, lambda n: lines(n.cast("string"), ".【答案】", _pick("ABCD", n))), _rows(41, 45, lambda n: lines(n.cast("string"), ".【答案】", _pick("ABCDE", n))))
    text = lines("2019年全国硕士研究生招生考试英语（一）真题\nSection I Use of English\nDirections: Fill the gaps. The ", name, " was 1 made and 2 sold.\n", cloze,
                 "\nSection II Reading Comprehension\nPart A\nText 1\nA text on ", name, ".\n21.What is ", name, " ", F.col("p_partkey").cast("string"), "?\n[A] ", kind, " [B] ", brand,
                 " [C] size ", size, " [D] none\nPart B\nDirections: Put them in order.\n", paragraphs, "\nSection III Translation\nDirections: Write in Chinese.\n", tasks,
                 "\nSection IV Writing\nPart A\n51. Directions: Write on ", name, ".\nPart B\n52. Directions: Describe ", brand, ".\n2019年英语（一）真题解析\nSection I Use of English\n", keys)
    return t.spread("part").select(F.col("p_partkey").alias("doc_id"), F.lit("2019-postgraduate.pdf").alias("file_name"), text.alias("text"))


POSTGRADUATE_SQL = """WITH q AS (
  SELECT p.*, 'cloze' AS kind, n, 'Blank ' || n AS stem, 'A.' || p_type || ' ' || n || '|B.' || p_brand || '|C.c' || p_size || '|D.none' AS options FROM part p, (SELECT unnest(range(1, 21)) AS n)
  UNION ALL SELECT p.*, 'reading', 21, 'What is ' || p_name || ' ' || p_partkey || '?', 'A.' || p_type || '|B.' || p_brand || '|C.size ' || p_size || '|D.none' FROM part p
  UNION ALL SELECT p.*, 'matching', n, 'Choose the paragraph for gap ' || n || '.', array_to_string(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: x || '.The ' || p_name || ' in place ' || x || '.'), '|')
    FROM part p, (SELECT unnest(range(41, 46)) AS n)
  UNION ALL SELECT p.*, 'translation', n, 'The ' || p_name || ' was sold ' || n || ' times.', '' FROM part p, (SELECT unnest(range(46, 51)) AS n))
SELECT p_partkey AS doc_id, kind, n::VARCHAR AS number, stem, options, CASE WHEN kind = 'matching' THEN substr('ABCDE', (p_partkey + n) % 5 + 1, 1)
  WHEN kind <> 'translation' THEN substr('ABCD', (p_partkey + n) % 4 + 1, 1) END AS answer FROM q"""


@query("english_postgraduate", POSTGRADUATE_SQL)
def english_postgraduate(t: Tables):
    """Questions, options and keys of every layout of a four-part paper."""
    _, _, questions = english.parse_papers(postgraduate_papers(t))
    return questions.select("doc_id", "kind", "number", "stem", options_text(F.col("options")).alias("options"), "answer")


@query("english_postgraduate_sections", """SELECT p_partkey AS doc_id, s.section_id, s.kind, s.part, s.questions::BIGINT AS questions,
  CASE s.kind WHEN 'cloze' THEN 'The ' || p_name || ' was 1 made and 2 sold.' ELSE '' END AS passage FROM (SELECT *, unnest([
  {section_id: 'section-1', kind: 'cloze', part: NULL, questions: 20}, {section_id: 'section-2-part-a-text-1', kind: 'reading', part: 'Part A', questions: 1},
  {section_id: 'section-2-part-b', kind: 'matching', part: 'Part B', questions: 5}, {section_id: 'section-3', kind: 'translation', part: NULL, questions: 5},
  {section_id: 'section-4-part-1', kind: 'writing', part: 'Part A', questions: 0}, {section_id: 'section-4-part-2', kind: 'writing', part: 'Part B', questions: 0}]) AS s FROM part)""")
def english_postgraduate_sections(t: Tables):
    """Sections and parts of the same papers, with the passage of the gaps."""
    _, sections, _ = english.parse_papers(postgraduate_papers(t))
    return sections.select("doc_id", "section_id", "kind", "part", "questions", F.when(F.col("kind") == "cloze", F.col("passage")).otherwise("").alias("passage"))


def college_papers(t: Tables):
    """A college paper for every part of the table: writing, listening, word bank, long reading, passages and translation, explained behind each."""
    def lines(*pieces):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    name, brand, kind, size = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    words = " ".join(f"{label}) {word}" for label, word in zip("ABCDE", BANK))
    options = lines("A) ", kind, "\nB) ", brand, "\nC) size ", size, "\nD) none\n")
    paragraphs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: lines(
        F.substring(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1)), ") The ", name, " on page ", i.cast("string"), ". [", (i + 36).cast("string"), "]")), "\n")
    details = F.array_join(F.transform(F.sequence(F.lit(36), F.lit(45)), lambda n: lines(n.cast("string"), ". 题干译文 Some ", name, " at ", n.cast("string"), ". 答案解析 ", F.substring(F.lit("ABCDEFGHIJ"), n - 35, F.lit(1)), ".")), "\n")
    text = lines("2018年12月六级真题\nPart I Writing\nWrite on ", name, ".\nPart II Listening Comprehension\nSection A\nConversation One\nW: The ", name, " is late. [1]\n1. Why is the ", name,
                 " late?\n", options, "解析：故选", _pick("ABCD", F.lit(1)), "\nPart III Reading Comprehension\nSection A\nThe ", name, " was [26] by ", brand, ".\n", words,
                 "\n答案详解\n26. ", _pick("ABCDE", F.lit(26)), ") ", F.element_at(F.array(*[F.lit(w) for w in BANK]), (F.pmod(F.col("p_partkey") + 26, F.lit(5)) + 1).cast("int")),
                 "\nSection B\n", paragraphs, "\n答案详解\n", details, "\nSection C\nPassage One\nThe ", name, " was sold.\n46. Who sold the ", name, "?\n", options, "解析：故选", _pick("ABCD", F.lit(46)),
                 "\nPart IV Translation\n请将以下关于", name, "的段落译成英语。")
    return t.spread("part").select(F.col("p_partkey").alias("doc_id"), F.lit("2018.12-CET6.pdf").alias("file_name"), text.alias("text"))


BANK = ["fragile", "delighted", "hollow", "tariffs", "distant"]


@query("english_college", f"""WITH q AS (
  SELECT p.*, 'listening' AS kind, 1 AS n, 'Why is the ' || p_name || ' late?' AS stem, 'A.' || p_type || '|B.' || p_brand || '|C.size ' || p_size || '|D.none 解析：故选' || substr('ABCD', (p_partkey + 1) % 4 + 1, 1) AS options,
    substr('ABCD', (p_partkey + 1) % 4 + 1, 1) AS answer FROM part p
  UNION ALL SELECT p.*, 'word-bank', n, 'Blank ' || n, '{"|".join(f"{a}.{w}" for a, w in zip("ABCDE", BANK))}', CASE WHEN n = 26 THEN substr('ABCDE', (p_partkey + 26) % 5 + 1, 1) END FROM part p, (SELECT unnest(range(26, 36)) AS n)
  UNION ALL SELECT p.*, 'long-reading', n, 'Some ' || p_name || ' at ' || n || '.', array_to_string(list_transform(range(10), lambda i: substr('ABCDEFGHIJ', i::INTEGER + 1, 1) || '.The ' || p_name || ' on page ' || i || '. [' || (i + 36) || ']'), '|'),
    substr('ABCDEFGHIJ', n::INTEGER - 35, 1) FROM part p, (SELECT unnest(range(36, 46)) AS n)
  UNION ALL SELECT p.*, 'reading', 46, 'Who sold the ' || p_name || '?', 'A.' || p_type || '|B.' || p_brand || '|C.size ' || p_size || '|D.none 解析：故选' || substr('ABCD', (p_partkey + 46) % 4 + 1, 1),
    substr('ABCD', (p_partkey + 46) % 4 + 1, 1) FROM part p)
SELECT p_partkey AS doc_id, kind, n::VARCHAR AS number, stem, options, answer FROM q""")
def english_college(t: Tables):
    """Questions, options and keys of every layout of a college paper; an explanation behind the last option stays with it."""
    _, _, questions = english.parse_papers(college_papers(t))
    return questions.select("doc_id", "kind", "number", "stem", options_text(F.col("options")).alias("options"), "answer")


@query("english_rejects", r"""SELECT p_partkey AS doc_id, length(regexp_replace(p_name || ' ' || repeat(p_type, p_size % 4), '\s', '', 'g'))::INTEGER AS characters, 'too_short' AS reason
FROM part WHERE length(regexp_replace(p_name || ' ' || repeat(p_type, p_size % 4), '\s', '', 'g')) < 30""")
def english_rejects(t: Tables):
    """Papers of too little text, with the reason."""
    text = F.concat("p_name", F.lit(" "), F.expr("repeat(p_type, p_size % 4)"))
    return english.rejected_papers(t.part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query("english_classes", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ielts' WHEN 1 THEN 'toefl' WHEN 2 THEN 'postgraduate' ELSE 'cet' END AS stage,
  CASE doc_id % 5 WHEN 2 THEN 'Postgraduate English I' WHEN 3 THEN 'CET-6' WHEN 4 THEN 'CET-4' END AS variant, CASE doc_id % 3 WHEN 0 THEN 'writing' WHEN 1 THEN 'cloze' ELSE 'matching' END AS kind FROM documents""")
def english_classes(t: Tables):
    name = F.element_at(F.array(*[F.lit(x) for x in ("IELTS 8", "托福", "考研英语（一）", "CET -6", "四级")]), (F.col("doc_id") % 5).cast("int") + 1)
    head = F.element_at(F.array(*[F.lit(x) for x in ("Essay", "Use of English", "Questions 41 – 45")]), (F.col("doc_id") % 3).cast("int") + 1)
    return t.texts().select("doc_id", english.stage_of(name, F.col("text")).alias("stage"), english.variant_of(name, F.col("text")).alias("variant"),
                            english.kind_of(head).alias("kind"))


@query("english_structured", f"""SELECT {PAPER_SQL} AS doc_id, 'ai-2-reading' AS section_id, (p_partkey % 900 + 1)::VARCHAR AS number, p_name AS stem,
  'A.' || p_type || '|C.' || p_brand AS options, CASE WHEN p_size % 3 = 1 THEN NULL ELSE substr('ABC', p_size % 3 + 1, 1) END AS answer FROM part""")
def english_structured(t: Tables):
    """Structured responses: every question, labels checked against the options."""
    item = F.concat(F.lit('{"number":"'), number(), F.lit('","stem":" '), "p_name", F.lit(' ","options":[{"label":"a.","text":"'), "p_type", F.lit('"},{"label":"(C)","text":"'), "p_brand",
                    F.lit('"},{"label":"A","text":"dup"},{"label":"?","text":"x"}],"answer":"'), letter(), F.lit('"}'))
    rows = t.part.select(paper_key().alias("doc_id"), F.col("p_partkey").alias("n"), item.alias("t"))
    head = '```json\n{"name":"x","stage":"cet","sections":[{"kind":"poem","passage":"p"},{"kind":"reading","passage":"Directions: do it.\\n\\nText.","questions":['
    content = F.concat(F.lit(head), _joined(F.struct("n", "t"), ","), F.lit("]}]}\n```"))
    docs = rows.groupBy("doc_id").agg(content.alias("content")).withColumn("file_name", F.lit("a.pdf"))
    _, questions = english.structured_papers(docs)
    return questions.select("doc_id", "section_id", "number", "stem", options_text(F.col("options")).alias("options"), "answer")


@query("bank_packages", """SELECT p_brand AS name, p_type || p_partkey AS id, p_name AS stem, (p_partkey % 7)::INTEGER AS answers FROM part""")
def bank_packages(t: Tables):
    """Banks written as JSON packages to the shared folder and read back."""
    qs = t.part.select(F.col("p_brand").alias("bank_id"), F.col("p_partkey").alias("pos"), F.concat("p_type", "p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("sourceNumber"),
                       F.col("p_type").alias("category"), F.col("p_name").alias("stem"), F.array(F.struct(F.lit("A").alias("label"), F.col("p_name").alias("text"))).alias("options"),
                       F.array_repeat(F.lit("A"), (F.col("p_partkey") % 7).cast("int")).alias("answer"))
    banks = t.part.select(F.col("p_brand").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("d").alias("description"), F.lit("g").alias("group_name"))
    path = shared_dir(t.spark, "packages")
    packages.write_bank_packages(banks, qs, path, "question-bank", "2024-01-01T00:00:00Z")
    good, _ = packages.read_bank_packages(t.spark, path, ["question-bank"], lines=True)
    return packages.explode_questions(good, "name").select("name", "id", "stem", F.size("answer").alias("answers"))


@query("test_packages", f"""SELECT {PAPER_SQL} AS name, CASE WHEN any_value(p_brand) LIKE '%1' THEN 'ielts' ELSE 'cet' END AS stage, count(*) AS questions,
  sum(p_size)::BIGINT AS checksum FROM part GROUP BY 1""")
def test_packages(t: Tables):
    """English tests written as packages and read back; an unknown stage becomes the default."""
    ask = F.struct(number().cast("string").alias("number"), F.col("p_name").alias("stem"), F.col("p_size").cast("string").alias("answer"))
    tests_ = t.part.groupBy(paper_key().alias("name"), "p_brand").agg(F.collect_list(ask).alias("questions")).select(
        "name", F.when(F.endswith("p_brand", F.lit("1")), "ielts").otherwise("school").alias("stage"), F.lit(None).cast("string").alias("examVariant"),
        F.lit(False).alias("usedOcr"), F.lit(None).cast("string").alias("answerSourceName"),
        F.array(F.struct(F.lit("s").alias("id"), F.lit("reading").alias("kind"), F.col("questions"))).alias("sections"))
    path = shared_dir(t.spark, "tests")
    packages.write_test_packages(tests_, path, "english-test", "2024-01-01T00:00:00Z")
    good, _ = packages.read_test_packages(t.spark, path, "english-test", lines=True)
    rows = good.select("name", "stage", F.explode(F.col("sections")[0]["questions"]).alias("q"))
    return rows.groupBy("name", "stage").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.col("q.answer").cast("bigint")).alias("checksum"))


@query("record_packages", """SELECT event_id AS user_id, CASE WHEN event_id % 7 = 0 THEN 'state' END AS reason, CASE WHEN event_id % 7 > 0 THEN '{"n":' || event_id || '}' END AS payload FROM events""")
def record_packages(t: Tables):
    """Learning records written and read back, with the rows that hold no state."""
    state = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "[1]").otherwise("{broken")).otherwise(F.concat(F.lit('{"n":'), "event_id", F.lit("}")))
    path = shared_dir(t.spark, "records")
    packages.write_records(t.events.select(F.col("event_id").cast("string").alias("user_id"), state.alias("state")), path, "notes", "2024-01-01T00:00:00Z")
    good, bad = packages.read_records(t.spark, path)
    return good.select(F.col("user_id").cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("reason"), "payload").unionByName(
        bad.select(F.col("user_id").cast("bigint").alias("user_id"), "reason", F.lit(None).cast("string").alias("payload")))


@query("keyed_upsert", """SELECT o_orderkey AS id, CASE WHEN l.k IS NOT NULL THEN 'new' ELSE o_orderstatus END AS status FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A') l ON l.k = o_orderkey""")
def keyed_upsert(t: Tables):
    current = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    incoming = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), F.lit("new").alias("status"))
    root = shared_dir(t.spark, "versions")
    tables.write_version(current, root, 1)
    tables.write_version(tables.upsert(tables.read_version(t.spark, root), incoming, ["id"]), root, 2)
    return tables.read_version(t.spark, root)


@query("insert_or_ignore", """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT l_orderkey, min(l_returnflag) FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY l_orderkey""")
def insert_or_ignore(t: Tables):
    current = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    incoming = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("status"))
    return tables.insert_or_ignore(current, incoming, ["id"], [F.col("status")])


@query("page_split", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i::INTEGER AS page, line AS text FROM l WHERE trim(line) <> ''""")
def page_split(t: Tables):
    """Whole documents with one page mark per line, split back to pages."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.concat(F.lit("[[PAGE "), i + 1, F.lit("]]\n"), l)), "")
    return tables.split_pages(t.texts().select("doc_id", marked.alias("text")), "doc_id", "text")
