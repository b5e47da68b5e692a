"""Exam text to question tables.

A document stays one row until its questions are known: its lines are an array, classified once, and the
chapter, section and answer-mode state is carried by cutting the array at the lines that change it
(``split_at``), which is linear in the text.  Questions meet their answers in the same row, as neighbours
in the order of chapter, kind and number.  The only shuffle is by document, for the final numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom import fixed as V
from gradeloom.functions.answers import label_array, options_last_wins, valid_answer
from gradeloom.functions.text import bind, clean_line, collapse, compact, first_int, trim_all

_L, _W, _D = V.LABEL_ANY_CASE, V.WS, V.DOT
NUM, VAL = "\u0001", "\u0002"
QUESTION_COLUMNS = ["source_number", "stem", "options", "answer", "answer_pending", "multiple", "answer_source",
                    "exam_profile", "exam_year", "exam_format", "question_type", "points"]


# -- lines -----------------------------------------------------------------------

def source_lines(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """Numbered clean lines as rows, blank ones included."""
    raw = F.split(F.translate(text, "\r", ""), "\n")
    return documents.select(doc, F.posexplode(raw).alias("n", "raw")).select(doc, "n", clean_line(F.col("raw")).alias("line"))


def split_at(rows: Column, begins) -> Column:
    """An array cut into slices that begin where ``begins(row, row before)`` holds; nothing for an empty array."""
    def cut(rows: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: (i == 1) | begins(F.get(rows, i - 1), F.get(rows, i - 2)))
        return bind(places, lambda places: F.transform(places, lambda at, j: F.slice(
            rows, at, F.coalesce(F.get(places, j + 1), F.size(rows) + 1) - at)))
    return bind(rows, lambda rows: F.when(F.size(rows) > 0, cut(rows)).otherwise(F.slice(F.array(rows), 1, 0)))


def _pairs(line: Column, marker: str, value: Column | None = None) -> Column:
    """Number/answer pairs of a line cut at every marker."""
    joined = F.regexp_replace(line, rf"(?<![A-Za-z0-9_])1{_W}+0{_W}*({_D})", "10$1")
    pieces = F.split(F.regexp_replace(joined, marker, f"{NUM}$1{VAL}"), NUM)
    return F.transform(F.filter(pieces, lambda p: F.contains(p, F.lit(VAL))), lambda p: F.struct(
        F.split_part(p, F.lit(VAL), F.lit(1)).alias("number"),
        F.regexp_replace(compact(F.split_part(p, F.lit(VAL), F.lit(2))), "[.。]+\\z", "").alias("value")))


PAIR_TYPE = "array<struct<number:string,answer:array<string>>>"


def letter_pairs(line: Column) -> Column:
    likely = line.rlike(rf"[0-9]{_W}*{_D}{_W}*{_L}")
    pairs = _pairs(line, rf"(?:^|{_W})([0-9]{{1,3}}){_W}*{_D}{_W}*")
    good = F.filter(pairs, lambda p: p["value"].rlike(rf"^{_L}{{1,7}}\z"))
    found = F.transform(good, lambda p: F.struct(p["number"].alias("number"), label_array(p["value"]).alias("answer")))
    return F.when(likely, found).otherwise(F.array().cast(PAIR_TYPE))


def judgement_pairs(line: Column) -> Column:
    marks = f"[{V.TRUE_MARK}{V.FALSE_MARK}]"
    pairs = _pairs(line, rf"(?:^|{_W})([0-9]{{1,3}}){_W}*(?:{_D}{_W}*)?(?={marks})")
    good = F.filter(pairs, lambda p: p["value"].isin(V.TRUE_MARK, V.FALSE_MARK))
    found = F.transform(good, lambda p: F.struct(p["number"].alias("number"), F.array(
        F.when(p["value"] == V.TRUE_MARK, "A").otherwise("B")).alias("answer")))
    return F.when(line.rlike(marks), found).otherwise(F.array().cast(PAIR_TYPE))


def _line(line: Column, n: Column) -> Column:
    """A line with everything the cuts ask of it."""
    numbered = F.regexp_extract(line, V.CHAPTER_LINE, 1)
    chapter = F.when(line.rlike(V.CHAPTER_LINE), trim_all(F.regexp_replace(numbered, rf"{_W}+答案\z", "")))
    chapter = F.coalesce(F.nullif(chapter, F.lit("")), F.nullif(trim_all(F.regexp_extract(line, V.ANSWER_HEADING_LINE, 1)), F.lit("")))
    section = F.lit(None)
    for kind, pattern in reversed(V.SECTION_LINES):
        section = F.when(line.rlike(pattern), kind).otherwise(section)

    def classed(chapter: Column, section: Column, pairs: Column) -> Column:
        jp, lp = pairs["j"], pairs["l"]
        use_j = line.rlike(f"[{V.TRUE_MARK}{V.FALSE_MARK}]") & (F.size(jp) > 0)
        inferred = F.when(use_j, "judgement").when(F.exists(lp, lambda p: F.size(p["answer"]) > 1), "multiple").otherwise("single")
        shape = (F.when(line == "", "blank").when(chapter.isNotNull(), "chapter").when(section.isNotNull(), "section")
                 .when(F.when(use_j, F.size(jp)).otherwise(F.size(lp)) >= 2, "dense").otherwise("other"))
        single_letter = line.rlike(rf"^[0-9]{{1,3}}{_W}*{_D}{_W}*{_L}(?:{_W}*{_L}){{0,6}}{_W}*\z")
        single_mark = line.rlike(rf"^[0-9]{{1,3}}{_W}*{_D}?{_W}*[{V.TRUE_MARK}{V.FALSE_MARK}]{_W}*\z")
        return bind(shape, lambda shape: F.struct(
            n.alias("n"), line.alias("line"), shape.alias("shape"), chapter.alias("chapter"), jp.alias("jp"), lp.alias("lp"),
            F.when(shape == "chapter", "none").when(shape == "section", section).when(shape == "dense", inferred).alias("kind"),
            F.when(shape == "chapter", line.rlike(rf"{_W}答案\z")).when(shape == "dense", F.lit(True)).otherwise(F.lit(False)).alias("mode"),
            F.when(shape == "other", F.when(single_mark, "mark").when(single_letter, "letter")).alias("single"),
            line.rlike(rf"^[0-9]{{1,3}}{_W}*{_D}").alias("start")))
    return bind(chapter, lambda c: bind(section.cast("string"), lambda s: bind(
        F.struct(judgement_pairs(line).alias("j"), letter_pairs(line).alias("l")), lambda p: classed(c, s, p))))


def _answers(rows: Column, kind: Column) -> Column:
    """(number, n, i, answer) of the answer lines of one kind."""
    def pairs(r: Column) -> Column:
        number = F.regexp_extract(r["line"], "^([0-9]{1,3})", 1)
        mark = F.array(F.when(F.contains(r["line"], F.lit(V.TRUE_MARK)), "A").otherwise("B"))
        own = F.when(r["single"] == "mark", mark).otherwise(label_array(F.regexp_replace(r["line"], "^[0-9]{1,3}", "")))
        return F.when(r["single"].isNotNull(), F.array(F.struct(number.alias("number"), own.alias("answer")))).when(kind == "judgement", r["jp"]).otherwise(r["lp"])
    return F.flatten(F.transform(rows, lambda r: F.transform(pairs(r), lambda p, i: F.struct(p["number"], r["n"], i.alias("i"), p["answer"]))))


def _questions(rows: Column) -> Column:
    """(number, n, body) of the question lines: a start and the lines up to the next one, joined."""
    head = rf"^([0-9]{{1,3}}){_W}*{_D}{_W}*"
    found = F.transform(split_at(rows, lambda r, _: r["start"]), lambda g: F.struct(
        F.when(g[0]["start"], F.regexp_extract(g[0]["line"], head, 1)).alias("number"), g[0]["n"].alias("n"),
        trim_all(F.array_join(F.transform(g, lambda r, i: F.when(i == 0, F.regexp_replace(r["line"], head, "")).otherwise(r["line"])), "\n")).alias("body")))
    return F.filter(found, lambda q: q["number"].isNotNull() & (q["body"] != ""))


#: A question (``draft``) or an answer; the fields up to ``i`` are the order in which they meet.
ITEM = ("array<struct<chapter:string,kind:string,number:string,draft:boolean,n:int,i:int,answer:array<string>,body:string>>")


def _items(part: Column, chapter: Column) -> Column:
    """Questions and answers of a slice that begins with the line that sets kind and mode."""
    def item(r: Column, kind: Column, draft: bool) -> Column:
        return F.struct(chapter.alias("chapter"), kind.alias("kind"), r["number"].alias("number"), F.lit(draft).alias("draft"), r["n"].alias("n"),
                        (F.lit(0) if draft else r["i"]).alias("i"), (F.lit(None).cast("array<string>") if draft else r["answer"]).alias("answer"),
                        (r["body"] if draft else F.lit(None).cast("string")).alias("body"))

    def found(first: Column, rest: Column) -> Column:
        turn = F.when(first["mode"], 0).otherwise(F.coalesce(F.get(F.filter(F.transform(rest, lambda r, i: F.when(r["single"].isNotNull(), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(rest)))
        kind = first["kind"]
        return bind(turn, lambda turn: F.concat(
            F.transform(_questions(F.slice(rest, F.lit(1), turn)), lambda q: item(q, kind, True)),
            F.transform(_answers(F.concat(F.when(first["shape"] == "dense", F.array(first)).otherwise(F.slice(rest, 1, 0)), F.slice(rest, turn + 1, F.size(rest))), kind),
                        lambda a: item(a, kind, False))))
    rest = F.filter(F.slice(part, F.lit(2), F.size(part)), lambda r: r["shape"] == "other")
    usable = part[0]["kind"].isNotNull() & ~part[0]["kind"].isin("none", "skip")
    return F.when(usable, bind(rest, lambda rest: found(part[0], rest)).cast(ITEM)).otherwise(F.array().cast(ITEM))


def paper_questions(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, chapter, kind, seq, number, body, table_answer): questions with the answer that their tables give.

    Of several answers to one chapter, kind and number the last line's counts.
    """
    raw = F.split(F.translate(text, "\r", ""), "\n")
    lines = documents.select(doc, F.transform(raw, lambda raw, n: bind(clean_line(raw), lambda line: _line(line, n))).alias("ls"))

    # The answer mode of a section follows from the four lines after it, blank ones counted.
    def moded(r: Column, i: Column) -> Column:
        ahead = F.slice(F.col("ls"), i + 2, F.lit(4))
        dense = F.when(r["kind"] == "judgement", F.exists(ahead, lambda x: F.size(x["jp"]) >= 2)).otherwise(F.exists(ahead, lambda x: F.size(x["lp"]) >= 2))
        return r.withField("mode", F.when(r["shape"] == "section", (r["kind"] != "skip") & dense).otherwise(r["mode"]))
    lines = lines.select(doc, F.transform("ls", moded).alias("ls"))
    chapters = lines.select(doc, F.transform(split_at(F.col("ls"), lambda r, _: r["shape"] == "chapter"), lambda c: F.struct(
        F.coalesce(c[0]["chapter"], F.lit(V.NO_CHAPTER)).alias("chapter"), split_at(c, lambda r, _: r["shape"].isin("section", "dense")).alias("parts"))).alias("cs"))
    items = chapters.select(doc, F.array_sort(F.flatten(F.transform("cs", lambda c: F.flatten(F.transform(c["parts"], lambda p: _items(p, c["chapter"])))))).alias("items"))

    def same(a: Column, b: Column) -> Column:
        return (a["chapter"] == b["chapter"]) & (a["kind"] == b["kind"]) & (a["number"] == b["number"])
    met = F.flatten(F.transform(split_at(F.col("items"), lambda r, before: ~same(r, before)), lambda g: bind(
        F.try_element_at(F.filter(g, lambda r: ~r["draft"]), F.lit(-1))["answer"],
        lambda answer: F.transform(F.filter(g, lambda r: r["draft"]), lambda q: q.withField("answer", answer)))))
    return items.select(doc, F.explode(met).alias("q")).select(
        doc, "q.chapter", "q.kind", F.col("q.n").alias("seq"), "q.number", "q.body", F.col("q.answer").alias("table_answer"))


# -- bodies ---------------------------------------------------------------------

def mark_options(body: Column) -> Column:
    """Body with every option marker replaced by control characters."""
    marker = rf"(?:^|\n){_W}*({V.LABEL})(?:{_W}*[.．、)）]{_W}*|{_W}+)|({V.LABEL}){_W}*[.．、]{_W}*"
    return F.regexp_replace(body, marker, f"{NUM}$1$2{VAL}")


def cut_options(pieces: Column) -> Column:
    """Option structs from a marked body cut at its markers (the first piece is the stem)."""
    options = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.struct(
        F.translate(F.split_part(p, F.lit(VAL), F.lit(1)), V.LABEL_FROM, V.LABEL_TO).alias("label"),
        collapse(F.split_part(p, F.lit(VAL), F.lit(2))).alias("text")))
    return F.filter(options, lambda o: o["text"] != "")


def without_answer_notes(text: Column) -> Column:
    text = F.regexp_replace(text, V.EXPLICIT_ANSWER, " ")
    text = F.regexp_replace(text, rf"[（(]{_W}*{_L}{_W}*[）)]{_W}*\z", " ")
    text = F.regexp_replace(text, rf"[:：]{_W}*{_L}{{1,7}}{_W}*\z", " ")
    return collapse(text)


def inline_answer(body: Column) -> Column:
    """Answer noted in the body, or at the end of the stem."""
    explicit = F.regexp_extract(body, V.EXPLICIT_ANSWER, 1)
    trailing = F.regexp_extract(F.split_part(mark_options(body), F.lit(NUM), F.lit(1)),
                                rf"(?:[:：]|[（(]){_W}*({_L}{{1,7}}){_W}*[）)]?{_W}*\z", 1)
    return label_array(F.when(F.contains(body, F.lit("答案")) & body.rlike(V.EXPLICIT_ANSWER), explicit).otherwise(trailing))


def sectioned_questions(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """Questions of chapter/section style texts joined with their answer tables."""
    joined = paper_questions(documents, doc, text)
    body, none = F.col("body"), F.array().cast("array<string>")
    table = F.coalesce("table_answer", none)

    def question(stem: Column, options: Column, answer: Column, markers: Column) -> Column:
        return F.struct(stem.alias("stem"), options.alias("options"), answer.alias("answer"), markers.alias("markers"))

    def judged(given: Column) -> Column:
        mark = F.regexp_extract(body, rf"([{V.TRUE_MARK}{V.FALSE_MARK}]){_W}*\z", 1)
        answer = (F.when(F.size(given) > 0, given)
                  .when(mark != "", F.array(F.when(mark == V.TRUE_MARK, "A").otherwise("B"))).otherwise(none))
        stem = collapse(F.regexp_replace(F.regexp_replace(body, rf"[（(]{_W}*[）)]", " "),
                                         rf"[{V.TRUE_MARK}{V.FALSE_MARK}]{_W}*\z", ""))
        options = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(text).alias("text"))
                            for label, text in (("A", V.TRUE_TEXT), ("B", V.FALSE_TEXT))])
        return question(stem, options, answer, F.lit(2))

    def choice(given: Column) -> Column:
        marked = mark_options(F.regexp_replace(body, V.EXPLICIT_ANSWER, " "))
        return bind(F.split(marked, NUM), lambda pieces: bind(
            options_last_wins(cut_options(pieces)), lambda options: question(
                without_answer_notes(F.get(pieces, F.lit(0))), options, valid_answer(given, options), F.size(pieces) - 1)))

    given = F.when(F.size(table) > 0, table).otherwise(inline_answer(body))
    built = bind(given, lambda g: F.when(F.col("kind") == "judgement", judged(g)).otherwise(choice(g)))
    # A generator keeps the rows that became questions, so the expressions run once.
    usable = F.filter(F.array(built), lambda q: (q["stem"] != "") & (q["markers"] >= 2) & (F.size(q["options"]) >= 2))
    kept = joined.select(doc, "chapter", "kind", "seq", F.col("number").alias("source_number"),
                         F.col("table_answer").isNotNull().alias("_linked"), F.explode(usable).alias("q"))
    label = F.lit(None)
    for kind, name in V.SECTION_LABEL.items():
        label = F.when(F.col("kind") == kind, name).otherwise(label)
    is_judged = F.col("kind") == "judgement"
    source = (F.when(F.col("_linked"), F.concat("chapter", F.lit(" · "), label, F.lit(V.ANSWER_TABLE_SUFFIX)))
              .when(F.size("q.answer") > 0, F.when(is_judged, V.INLINE_JUDGEMENT_SOURCE).otherwise(V.INLINE_CHOICE_SOURCE)))
    return kept.select(
        doc, "chapter", "kind", "seq", "source_number", "q.stem", "q.options", "q.answer",
        (F.size("q.answer") == 0).alias("answer_pending"),
        (~is_judged & ((F.col("kind") == "multiple") | (F.size("q.answer") > 1))).alias("multiple"),
        source.alias("answer_source"))


# -- answer-delimited texts --------------------------------------------------------

def delimited_questions(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """Questions of texts where every question ends with an answer mark.

    The text is cut at the marks inside its own row; chunk i continues the tail of
    chunk i-1, so neither a shuffle nor a window is needed to pair them.  A question without a number of its
    own has a null one; ``parse_questions`` gives it its place.
    """
    lead = rf"\A{_W}*({V.ANSWER_LETTERS})"
    next_question = rf"(?:^|\n){_W}*[0-9]+{_W}*[.．、]"
    pieces = documents.select(doc, F.split(F.translate(text, "\r", ""), V.ANSWER_SPLIT).alias("c"))
    rows = pieces.select(doc, F.posexplode(F.transform("c", lambda x, i: F.struct(
        F.when(i > 0, F.get("c", i - 1)).alias("prev"), x.alias("this")))).alias("seq", "p")).where("seq > 0")

    def after_letters(chunk: Column) -> Column:
        return F.regexp_replace(chunk, lead, "")

    def head(chunk: Column) -> Column:
        # text up to the next question start, empty when there is none
        return F.when(chunk.rlike(next_question), F.regexp_replace(chunk, rf"({next_question})[\s\S]*\z", "")).otherwise("")

    def tail(chunk: Column) -> Column:
        cut = F.regexp_extract(chunk, rf"({next_question}[\s\S]*)\z", 1)
        return trim_all(F.when(chunk.rlike(next_question), cut).otherwise(chunk))

    prev, this = F.col("p.prev"), F.col("p.this")
    carried = F.when(F.col("seq") == 1, prev).when(prev.rlike(lead), tail(after_letters(prev))).otherwise(prev)
    body = trim_all(F.regexp_replace(F.concat(carried, F.lit("\n"), head(after_letters(this))), "[ \t]+", " "))
    number_head = rf"\A{_W}*([0-9]+){_W}*[.．、]{_W}*"

    def header(body: Column) -> Column:
        year = F.nullif(F.regexp_extract(body, V.EXAM_HEADER, 1), F.lit("")).cast("int")
        return bind(year, lambda year: F.struct(
            year.alias("year"), F.when(year.isNotNull(), F.regexp_extract(body, V.EXAM_HEADER, 2)).alias("number"),
            F.when(year.isNotNull(), F.nullif(F.upper(F.regexp_extract(body, V.EXAM_HEADER, 3)), F.lit(""))).alias("type"),
            F.split(F.regexp_replace(F.when(year.isNotNull(), F.regexp_replace(body, rf"\A[\s\S]*?{V.EXAM_HEADER}", "")).otherwise(body),
                                     rf"({_L}){_W}*[.．、]{_W}*", f"{NUM}$1{VAL}"), NUM).alias("pieces")))

    def question(given: Column, head: Column) -> Column:
        options = F.filter(F.transform(F.slice(head["pieces"], F.lit(2), F.size(head["pieces"])), lambda x: F.struct(
            F.translate(F.split_part(x, F.lit(VAL), F.lit(1)), V.LABEL_FROM, V.LABEL_TO).alias("label"),
            trim_all(F.regexp_replace(F.split_part(x, F.lit(VAL), F.lit(2)), "\n+", " ")).alias("text"))), lambda o: o["text"] != "")
        return bind(options, lambda options: F.struct(
            head.alias("head"), F.nullif(F.regexp_extract(head["pieces"][0], number_head, 1), F.lit("")).alias("number"),
            trim_all(F.regexp_replace(F.regexp_replace(head["pieces"][0], number_head, ""), "\n+", " ")).alias("stem"),
            options.alias("options"), valid_answer(given, options).alias("answer")))
    # Generators keep the rows that became questions, so no filter repeats the expressions.
    marked = F.filter(F.array(label_array(F.regexp_extract(this, lead, 1))), lambda g: this.rlike(lead) & (F.size(g) > 0))
    given = rows.select(doc, "seq", "p", F.explode(marked).alias("given"))
    built = F.filter(F.array(bind(body, lambda body: bind(header(body), lambda head: question(F.col("given"), head)))),
                     lambda q: (q["stem"] != "") & (F.size(q["options"]) >= 2) & (F.size(q["answer"]) > 0))
    kept = given.select(doc, "seq", F.explode(built).alias("q"))
    year, n = F.col("q.head.year"), F.col("q.head.number").cast("int")
    fmt = F.when(year.isNotNull(), F.when(year >= V.MODERN_FROM_YEAR, V.MODERN).otherwise(V.LEGACY))
    points = F.when(fmt == V.MODERN, F.when(n <= 40, 1.5).when(n <= 115, 2.0).when(n <= 135, 1.5).otherwise(2.0))
    return kept.select(
        doc, "seq", F.coalesce("q.head.number", "q.number").alias("source_number"), "q.stem", "q.options", "q.answer",
        F.lit(False).alias("answer_pending"), (F.coalesce(F.col("q.head.type") == "X", F.lit(False)) | (F.size("q.answer") > 1)).alias("multiple"),
        F.lit(None).cast("string").alias("answer_source"), F.when(year.isNotNull(), V.PROFILE).alias("exam_profile"), year.alias("exam_year"),
        fmt.alias("exam_format"), F.col("q.head.type").alias("question_type"), points.alias("points"))


def parse_questions(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Questions of exam texts of either style, duplicates removed, numbered per document."""
    found = (delimited_questions(documents, doc, text).withColumn("_style", F.lit(0))
             .unionByName(sectioned_questions(documents, doc, text).drop("chapter", "kind").withColumn("_style", F.lit(1)),
                          allowMissingColumns=True)).repartition(doc)  # all that follows is by document
    place = F.row_number().over(Window.partitionBy(doc).orderBy("_style", "seq"))
    found = found.withColumn("source_number", F.coalesce("source_number", place.cast("string")))
    key = F.concat_ws("|", "source_number", F.substring(compact(F.col("stem")), 1, 180))
    row = F.struct(*QUESTION_COLUMNS)
    at = F.struct("_style", "seq")
    best = found.withColumn("_key", key).groupBy(doc, "_key").agg(
        F.min(at).alias("_first"), F.min_by(row, F.struct(F.size("answer") == 0, at)).alias("q"))
    pos = F.row_number().over(Window.partitionBy(doc).orderBy("_first"))
    return best.select(doc, pos.alias("pos"), "q.*").withColumn(
        "id", F.sha2(F.concat_ws("|", F.col(doc).cast("string"), "source_number", "stem"), 256))


def source_int(column: str = "source_number") -> Column:
    return first_int(F.col(column))
