"""English papers: sections, questions and answer keys from plain text.

A paper is cut at its markers inside its own row, its questions meet their keys there,
and it is exploded into sections or questions; nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.text import bind, collapse, trim_all

SEP, MID = "\u0001", "\u0002"
OPTION = "array<struct<label:string,text:string>>"
SECTION = ("struct<kind:string,title:string,part:string,suffix:string,mode:string,low:int,high:int,text:string>")


def normal_text(text: Column) -> Column:
    out = F.translate(text, chr(0xA0) + "ＡＢＣＤ．\r", " ABCD.")
    return trim_all(F.regexp_replace(F.regexp_replace(out, "[ \t]+\n", "\n"), "\n{4,}", "\n\n\n"))


def cut(text: Column, pattern: str) -> Column:
    """Pieces from each marker to the next; empty when no marker matches."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{SEP}$1"), SEP)
    return bind(pieces, lambda p: F.slice(p, F.lit(2), F.size(p)))


def before(text: Column, pattern: str) -> Column:
    """Text up to the first match, all of it when nothing matches."""
    return F.get(F.split(F.regexp_replace(text, pattern, SEP), SEP), F.lit(0))


def before_last(text: Column, pattern: str) -> Column:
    """Text up to the last place where the pattern matches, empty when nothing matches."""
    return F.left(text, F.length(text) - F.length(F.element_at(F.split(text, f"(?={pattern})"), -1)))


def from_first(text: Column, pattern: str) -> Column:
    """Text from the first match on, null when nothing matches."""
    return F.nullif(F.regexp_extract(text, rf"({pattern}[\s\S]*)\z", 1), F.lit(""))


def sanitize(passage: Column) -> Column:
    """Passage without page marks, headings, directions and point notes."""
    w = V.WS
    text = F.regexp_replace(passage, rf"(?i)\A{w}*(?:\[\[PAGE{w}+[0-9]+\]\]{w}*)?", "")
    text = F.regexp_replace(text, rf"(?i)\A{w}*(?:Section{w}+[IVX0-9A-D]+{w}*)?(?:Part{w}+[IVX0-9A-D]+{w}*)?(?:{V.TASK_WORDS})[^\n]*\n?", "")
    text = F.regexp_replace(text, rf"(?i)\A{w}*Part{w}+[A-DIVX0-9]+{w}*\n?", "")
    text = F.regexp_replace(text, rf"(?i)\A{w}*(?:Text|Passage){w}+(?:[1-4]|One|Two|Three|Four){w}*\n?", "")

    def plain(body: Column) -> Column:
        out = F.regexp_replace(body, V.DIRECTIONS, "")
        for _ in range(5):
            out = F.regexp_replace(out, V.INSTRUCTION, "")
        return F.regexp_replace(out, V.POINTS_NOTE, "")

    return bind(text, lambda b: trim_all(
        F.when(b.rlike(V.DIRECTIONS_TO_SHEET), F.regexp_replace(b, V.DIRECTIONS_TO_SHEET, ""))
        .when(b.rlike(V.DIRECTIONS), plain(b)).otherwise(b)))


def _lead(text: Column) -> Column:
    """Text in front of the first question, without its heading."""
    head = before(text, V.EN_QUESTION_SPACED)
    return trim_all(F.regexp_replace(head, rf"(?i)\A{V.WS}*(?:part{V.WS}+[ivx0-9]+{V.WS}*)?(?:{V.TASK_WORDS})[^\n]*\n?", ""))


# -- classification ------------------------------------------------------------------

def _first_rule(text: Column, rules: list[tuple[str, str]], default) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def stage_of(name: Column, text: Column) -> Column:
    sample = F.lower(F.concat(name, F.lit("\n"), text))
    return _first_rule(sample, V.STAGE_RULES, V.STAGES[0])


def variant_of(name: Column, text: Column) -> Column:
    sample = F.concat(name, F.lit("\n"), text)
    return (F.when(sample.rlike(V.CET6), V.VARIANTS[0]).when(sample.rlike(V.CET4), V.VARIANTS[1])
            .when(sample.rlike(V.POSTGRADUATE_I) & sample.rlike(V.POSTGRADUATE), V.VARIANTS[2]))


def kind_of(value: Column) -> Column:
    return _first_rule(F.lower(value), V.KIND_RULES, "reading")


# -- answers ---------------------------------------------------------------------------

def answer_keys(text: Column, is_cet: Column) -> Column:
    """Answers and explanations of a paper, one for every question number.

    Word-bank keys win, then bracketed keys (the last), then the list after the last
    answer heading and the explanation blocks (the first of each).
    """
    t = text
    empty = F.array().cast("array<struct<number:string,source:int,at:int,answer:string,explanation:string>>")

    def keys(pieces: Column, source: int, number: str, answer, note, last: bool) -> Column:
        return F.transform(pieces, lambda p, i: F.struct(
            F.regexp_extract(p, number, 1).alias("number"), F.lit(source).alias("source"), (i * (-1 if last else 1)).alias("at"),
            F.upper(answer(p)).alias("answer"), F.nullif(note(p), F.lit("")).alias("explanation")))

    def key_note(p: Column) -> Column:
        return collapse(F.regexp_replace(F.regexp_extract(p, V.EN_KEY_NOTE, 1), rf"(?:^|\n){V.WS}*[0-9]{{1,3}}{V.WS}*(?:\n|\z)", " "))

    def word_note(p: Column) -> Column:
        return F.concat(F.lit("The source explanation identifies "), F.regexp_extract(p, V.CET_WORD_KEY, 3),
                        F.lit(" as the word for blank "), F.regexp_extract(p, V.CET_WORD_KEY, 1), F.lit("."))

    def block_body(p: Column) -> Column:
        return F.regexp_replace(p, rf"\A{V.CET_BLOCK}", "")

    def block_key(p: Column) -> Column:
        return bind(block_body(p), lambda body: F.coalesce(
            F.nullif(F.concat(F.regexp_extract(body, V.CET_BLOCK_KEY, 1), F.regexp_extract(body, V.CET_BLOCK_KEY, 2)), F.lit("")),
            F.regexp_extract(body, V.CET_BLOCK_KEY_2, 1)))

    def block_note(p: Column) -> Column:
        return bind(block_body(p), lambda body: collapse(F.coalesce(from_first(body, V.CET_NOTE), body)))

    listed_text = F.when(t.rlike(V.EN_KEY_HEADING), F.element_at(F.split(t, V.EN_KEY_HEADING), -1)).otherwise("")
    common = F.concat(
        keys(cut(t, V.EN_KEY), 1, V.EN_KEY, lambda p: F.regexp_extract(p, V.EN_KEY, 2), key_note, True),
        keys(F.regexp_extract_all(listed_text, F.lit(V.EN_KEY_LIST), F.lit(0)), 2, V.EN_KEY_LIST,
             lambda p: F.regexp_extract(p, V.EN_KEY_LIST, 2), lambda p: F.lit(""), False))
    college = F.concat(
        keys(F.regexp_extract_all(t, F.lit(V.CET_WORD_KEY), F.lit(0)), 0, V.CET_WORD_KEY,
             lambda p: F.regexp_extract(p, V.CET_WORD_KEY, 2), word_note, True),
        keys(cut(t, V.CET_BLOCK), 3, V.CET_BLOCK, block_key, block_note, False))
    found = F.filter(F.concat(common, F.when(is_cet, college).otherwise(empty)), lambda k: (k["answer"] != "") & (k["number"] != ""))
    # Sorted by number, source and place, so the first of a number is the one that holds.
    return bind(F.array_sort(found), lambda ks: F.filter(ks, lambda k, i: (i == 0) | (F.get(ks, i - 1)["number"] != k["number"])))


def without_answers(text: Column) -> Column:
    """Paper without its answer area."""
    def first(pattern: str) -> Column:
        return F.get(F.split(text, pattern, 2), F.lit(0))

    head = F.when(text.rlike(V.EN_KEY_ONE), first(V.EN_KEY_ONE)).otherwise(first(V.EN_KEY))
    keyed = bind(head, lambda h: F.when(h.rlike(V.EN_NOTES_START), before_last(h, V.EN_NOTES_START)).otherwise(h))
    return (F.when(text.rlike(V.EN_KEY), keyed)
            .when(text.rlike(V.EN_KEY_HEADING), before_last(text, V.EN_KEY_HEADING)).otherwise(text))


# -- sections ---------------------------------------------------------------------------

def _section(text: Column, kind, title, part, suffix, mode: str, low: int = 1, high: int = 999) -> Column:
    as_col = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
    return F.struct(as_col(kind).alias("kind"), as_col(title).alias("title"), as_col(part).alias("part"), as_col(suffix).alias("suffix"),
                    F.lit(mode).alias("mode"), F.lit(low).alias("low"), F.lit(high).alias("high"), text.alias("text")).cast(SECTION)


def _or_whole(text: Column, pattern: str) -> Column:
    return bind(cut(text, pattern), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def _labelled(text: Column, pattern: str, make: Callable[[Column, Column], Column]) -> Column:
    return F.transform(_or_whole(text, pattern), make)


def _general(slice_text: Column) -> Column:
    """Sections of one headed slice."""
    with_parts = slice_text.rlike(V.EN_HAS_PARTS)

    def part_of(p: Column) -> Column:
        return F.nullif(F.upper(F.regexp_extract(p, rf"\A{V.EN_PART}", 1)), F.lit(""))

    def reading_part(p: Column) -> Column:
        name = F.concat(F.lit("Part "), part_of(p))
        suffix = F.concat(F.lit("-part-"), F.lower(part_of(p)))
        texts = _labelled(p, V.EN_TEXT, lambda t, i: _section(
            t, "reading", F.concat(F.lit("Reading Part A · "), F.when(t.rlike(rf"\A{V.EN_TEXT}"), F.concat(
                F.lit("Text "), F.regexp_extract(t, V.EN_TEXT, 1))).otherwise("Text Comprehension")),
            name, F.concat(F.coalesce(suffix, F.lit("-1")), F.lit("-text-"), (i + 1).cast("string")), "standard", 21, 40))
        matching = F.array(_section(p, "matching", "Reading Part B · Paragraph Matching", "Part B", suffix, "matching", 41, 45))
        return F.when(F.coalesce(part_of(p) == "B", F.lit(False)), matching).otherwise(texts)

    def writing_part(p: Column, i: Column) -> Column:
        number = F.when(F.coalesce(part_of(p) == "B", F.lit(False)), "52").otherwise("51")
        name = F.concat(F.lit("Part "), part_of(p))
        return _section(p, "writing", F.concat(F.coalesce(name, F.lit("Writing")), F.lit(" · Question "), number), name,
                        F.concat(F.lit("-part-"), (i + 1).cast("string")), "prompt")

    def of_kind(label: Column, kind: Column) -> Column:
        whole = F.array(_section(slice_text, kind, F.coalesce(label, F.lit("Imported Practice")), None, "", "standard"))
        return (F.when(kind == "translation", F.array(_section(slice_text, "translation", "Section III · Translation", None, "", "translation", 46, 50)))
                .when((kind == "reading") & with_parts, F.flatten(F.transform(_or_whole(slice_text, V.EN_PART), reading_part)))
                .when((kind == "writing") & with_parts, F.transform(_or_whole(slice_text, V.EN_PART), writing_part))
                .when(kind == "cloze", F.array(_section(slice_text, "cloze", label, None, "", "cloze", 1, 20)))
                .when(kind == "writing", F.array(_section(slice_text, "writing", label, None, "", "passage")))
                .otherwise(whole))

    label = F.when(slice_text.rlike(rf"\A{V.EN_HEADING}"), trim_all(F.regexp_extract(slice_text, V.EN_HEADING, 1)))
    return bind(label, lambda name: bind(kind_of(F.coalesce(name, F.lit("Imported Practice"))), lambda kind: of_kind(name, kind)))


def _cet(body: Column) -> Column:
    """Sections of a college-English paper, in part order; empty without part headings."""
    none = F.array().cast(f"array<{SECTION}>")
    entries = F.transform(cut(body, V.CET_PART), lambda p: F.struct(F.upper(F.regexp_extract(p, V.CET_PART, 1)).alias("k"), p.alias("v")))

    def part(es: Column, number: str) -> Column:  # the last of a number
        return F.try_element_at(F.filter(es, lambda e: e["k"] == number), F.lit(-1))["v"].alias(number)
    parts = bind(entries, lambda es: F.struct(F.size(es).alias("n"), *[part(es, number) for number in ("I", "II", "III", "IV")]))

    def title(prefix: str, t: Column, pattern: str) -> Column:
        name = F.when(t.rlike(rf"\A{pattern}"), collapse(F.regexp_extract(t, pattern, 0))).otherwise("Practice")
        return F.concat(F.lit(prefix), name)

    def reading(text: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            given = F.upper(F.regexp_extract(s, rf"\A{V.CET_SECTION}", 1))
            letter = F.when(given != "", given).otherwise(F.when(i == 0, "A").when(i == 1, "B").otherwise("C"))
            passages = _labelled(s, V.CET_PASSAGE, lambda t, j: _section(
                t, "reading", title("Reading Section C · ", t, V.CET_PASSAGE), "Section C",
                F.concat(F.lit("cet-reading-section-c-passage-"), (j + 1).cast("string")), "standard", 46, 55))
            return bind(letter, lambda x: (
                F.when(x == "A", F.array(_section(s, "word-bank", "Reading Section A · Word Bank", "Section A", "cet-reading-section-a", "word-bank", 26, 35)))
                .when(x == "B", F.array(_section(s, "long-reading", "Reading Section B · Long Reading", "Section B", "cet-reading-section-b", "long-reading", 36, 45)))
                .otherwise(passages)))
        return F.flatten(F.transform(cut(text, V.CET_SECTION), one))

    def lost_reading(head: Column) -> Column:
        # from the section heading before the first word key to the translation task
        rest = F.substring(body, F.length(head) + 1, F.length(body))
        lead = F.when(F.contains(head, F.lit("Section")), F.concat(F.lit("Section"), F.substring_index(head, "Section", -1))).otherwise("")
        ends = ~head.rlike(V.CET_TRANSLATION_CUE) & rest.rlike(V.CET_TRANSLATION_CUE)
        return F.concat(lead, F.when(ends, before(rest, V.CET_TRANSLATION_CUE)).otherwise(rest))

    def lost_translation(head: Column) -> Column:
        topic = F.substring(body, F.length(head) + 1, F.length(body))
        page = F.when(F.contains(head, F.lit("[[PAGE ")), F.concat(F.lit("[[PAGE "), F.substring_index(head, "[[PAGE ", -1))).otherwise("")
        return F.concat(page, topic)

    third = F.when(body.rlike(V.CET_FIRST_WORD_KEY), bind(before(body, V.CET_FIRST_WORD_KEY), lost_reading))
    fourth = F.when(body.rlike(V.CET_TRANSLATION_TOPIC), bind(before(body, V.CET_TRANSLATION_TOPIC), lost_translation))

    def build(m: Column) -> Column:
        return bind(F.coalesce(m["III"], third), lambda three: bind(F.coalesce(m["IV"], fourth), lambda four: assemble(m, three, four)))

    def assemble(m: Column, three: Column, four: Column) -> Column:
        writing = F.regexp_replace(m["I"], rf"(?i)\A[\s\S]*?Writing{V.WS}*", "")
        talks = _labelled(m["II"], V.CET_TALK, lambda t, i: _section(
            t, "listening", title("Listening · ", t, V.CET_TALK), "Part II", F.concat(F.lit("cet-listening-"), (i + 1).cast("string")), "standard", 1, 25))
        return F.concat(
            F.when(m["I"].isNotNull(), F.array(_section(writing, "writing", "CET-6 Writing", "Part I", "cet-writing", "text"))).otherwise(none),
            F.when(m["II"].isNotNull(), talks).otherwise(none), F.when(three.isNotNull(), reading(three)).otherwise(none),
            F.when(four.isNotNull(), F.array(_section(before(four, V.CET_REFERENCE), "translation",
                   "CET-6 Translation · Chinese to English", "Part IV", "cet-translation", "text"))).otherwise(none))

    return bind(parts, lambda m: F.when(m["n"] > 0, build(m)).otherwise(none))


def prepare(papers: DataFrame, doc: str = "doc_id", name: str = "file_name", text: str = "text") -> DataFrame:
    """Normalised papers with enough text; the others are told by ``rejected_papers``."""
    # Not a plain filter: Spark moves one below the exchange that spreads the papers, where few tasks write and normalise every text once more.
    body = bind(normal_text(F.col(text)), lambda b: F.when(_long_enough(b), b))
    base = papers.select(doc, name, F.explode_outer(F.array(body)).alias("body")).where("body is not null")
    return base.withColumn("is_cet", F.col("body").rlike(V.CET_PAPER))


def _long_enough(body: Column) -> Column:
    return F.coalesce(body.rlike(rf"\A(?:{V.WS}*+{V.NON_WS}){{30}}"), F.lit(False))


def rejected_papers(papers: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, characters, reason) of the papers that have too little text to be read, white space not counted."""
    body = normal_text(F.col(text))
    short = papers.where(~_long_enough(body))
    return short.select(doc, F.coalesce(F.length(F.regexp_replace(body, V.WS, "")), F.lit(0)).alias("characters"), F.lit("too_short").alias("reason"))


def _passage(s: Column) -> Column:
    t, mode = s["text"], s["mode"]
    prompt = rf"(?i){V.LINE_START}{V.WS}*5[12]{V.WS}*[.、]{V.WS}*"
    area = (F.when(mode == "matching", before(t, V.EN_FIRST_OPTION)).when(mode == "cloze", before(t, V.EN_CLOZE_ROW))
            .when(mode == "word-bank", before(t, V.CET_DETAIL)).when(mode == "long-reading", before(t, V.CET_LONG_DETAIL))
            .otherwise(_lead(t)))
    return (F.when(mode == "prompt", collapse(F.coalesce(from_first(t, prompt), t)))
            .when(mode == "text", trim_all(t)).otherwise(sanitize(area)))


def _filled(s: Column) -> Column:
    return F.struct(s["suffix"].alias("section_id"), *[s[c].alias(c) for c in ("kind", "title", "part", "mode", "low")],
                    _passage(s).alias("passage"), _questions(s).alias("questions"))


def paper_tree(body: Column, is_cet: Column) -> Column:
    """Sections of a paper with passage and questions, as one array."""
    none = F.array().cast(f"array<{SECTION}>")
    cet = F.when(is_cet, _cet(body)).otherwise(none)
    general = bind(without_answers(body), lambda b: F.flatten(F.transform(
        _or_whole(b, V.EN_HEADING), lambda s, i: F.transform(_general(s), lambda x: x.withField(
            "suffix", F.concat(F.lit("section-"), (i + 1).cast("string"), x["suffix"]))))))
    chosen = bind(cet, lambda c: F.when(F.size(c) > 0, c).otherwise(general))
    filled = F.transform(chosen, _filled)
    # Parts and prompts always count; other sections need a passage or questions.
    shown = F.filter(filled, lambda s: (s["passage"] != "") | (F.size(s["questions"]) > 0)
                     | s["mode"].isin("prompt", "matching", "translation") | (s["low"] == 21))
    whole = F.filter(F.transform(F.array(_section(without_answers(body), "reading", "Imported Questions", None, "section-fallback", "standard")), _filled),
                     lambda s: F.size(s["questions"]) > 0)
    return bind(shown, lambda t: F.when(F.exists(t, lambda s: F.size(s["questions"]) > 0), t).otherwise(F.concat(t, whole)))


# -- questions ------------------------------------------------------------------------------

def _options(marked: Column) -> Column:
    pieces = F.split(marked, SEP)
    return bind(pieces, lambda ps: F.filter(F.transform(F.slice(ps, F.lit(2), F.size(ps)), lambda p: F.struct(
        F.split_part(p, F.lit(MID), F.lit(1)).alias("label"), collapse(F.split_part(p, F.lit(MID), F.lit(2))).alias("text"))),
        lambda o: o["text"] != ""))


def bracket_options(text: Column) -> Column:
    return _options(F.regexp_replace(text, V.EN_OPTION, f"{SEP}$1$2{MID}"))


def _questions(s: Column) -> Column:
    """Questions of a section by its layout; ``located`` is an answer read from the passage."""
    t = s["text"]
    empty = F.array().cast(OPTION)

    def question(number: Column, stem: Column, options: Column, located: Column | None = None) -> Column:
        place = F.lit(None) if located is None else located
        return F.struct(number.cast("string").alias("number"), stem.alias("stem"), options.cast(OPTION).alias("options"),
                        place.cast("string").alias("located"))

    def standard(piece: Column) -> Column:
        body = trim_all(F.regexp_replace(piece, rf"\A{V.EN_QUESTION}", ""))
        return bind(F.regexp_replace(body, V.EN_OPTION, f"{SEP}$1$2{MID}"), lambda m: question(
            F.regexp_extract(piece, V.EN_QUESTION, 1), collapse(F.split_part(m, F.lit(SEP), F.lit(1))), _options(m)))

    def cloze(piece: Column) -> Column:
        number = F.regexp_extract(piece, V.EN_CLOZE_ROW, 1)
        found = bracket_options(F.regexp_replace(piece, rf"\A{V.LINE_START}{V.WS}*[0-9]+{V.WS}+", ""))
        return question(number, F.concat(F.lit("Blank "), number), F.filter(found, lambda o: o["label"] <= "D"))

    def numbered(low: int, high: int, stem: Callable[[Column], Column], options: Column) -> Column:
        return bind(options, lambda o: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: question(n, stem(n), o)))

    paragraphs = bind(bracket_options(F.coalesce(from_first(t, V.EN_FIRST_OPTION), t)), lambda o: bind(
        F.filter(o, lambda x: ~x["label"].isin("F", "G")), lambda s: F.when(F.size(s) >= 5, s).otherwise(o)))
    matching = numbered(41, 45, lambda n: F.concat(F.lit("Choose the paragraph for gap "), n.cast("string"), F.lit(".")), paragraphs)

    area = before(t, V.CET_DETAIL)
    bank = F.transform(F.regexp_extract_all(area, F.lit(V.CET_WORD), F.lit(0)), lambda w: F.struct(
        F.regexp_extract(w, V.CET_WORD, 1).alias("label"), F.regexp_extract(w, V.CET_WORD, 2).alias("text")))
    from gradeloom.functions.answers import options_first_wins
    word_bank = numbered(26, 35, lambda n: F.concat(F.lit("Blank "), n.cast("string")), options_first_wins(bank))

    long_text = before(t, V.CET_LONG_DETAIL)
    letters = _options(F.regexp_replace(long_text, V.CET_PARAGRAPH, f"{SEP}$1{MID}"))
    detail = F.coalesce(from_first(t, V.CET_LONG_DETAIL), F.lit(""))

    def statement(n: Column, pieces: Column) -> Column:
        own = F.filter(pieces, lambda p: F.regexp_extract(p, V.CET_STATEMENT, 1) == n.cast("string"))
        text = F.regexp_replace(F.try_element_at(own, F.lit(-1)), rf"\A{V.CET_STATEMENT}", "")
        text = collapse(F.regexp_replace(before(text, "答案解析|解析"), rf"\A{V.WS}*题干译文{V.WS}*", ""))
        return F.coalesce(F.nullif(text, F.lit("")), F.concat(
            F.lit("Statement "), n.cast("string"), F.lit(" — choose the paragraph containing the matching information.")))

    def located(n: Column, options: Column) -> Column:
        marked = F.filter(options, lambda o: F.rlike(o["text"], F.concat(F.lit(r"[【\[(]"), n.cast("string"), F.lit(r"[】\])]"))))
        return F.try_element_at(marked, F.lit(-1))["label"]

    long_reading = bind(cut(detail, V.CET_STATEMENT), lambda ps: bind(letters, lambda o: F.transform(
        F.sequence(F.lit(36), F.lit(45)), lambda n: question(n, statement(n, ps), o, located(n, o)))))
    translation = F.transform(cut(t, V.EN_TRANSLATION), lambda p: question(
        F.regexp_extract(p, V.EN_TRANSLATION, 1), collapse(F.regexp_replace(p, rf"\A{V.EN_TRANSLATION}", "")), empty))

    mode = s["mode"]
    found = (F.when(mode == "matching", matching).when(mode == "word-bank", word_bank).when(mode == "long-reading", long_reading)
             .when(mode == "translation", translation)
             .when(mode == "cloze", F.filter(F.transform(cut(t, V.EN_CLOZE_ROW), cloze), lambda q: F.size(q["options"]) >= 2))
             .when(mode == "standard", F.filter(F.transform(cut(t, V.EN_QUESTION), standard),
                                                lambda q: (q["stem"] != "") & (F.size(q["options"]) >= 2)))
             .otherwise(F.array().cast(f"array<struct<number:string,stem:string,options:{OPTION},located:string>>")))
    return F.filter(found, lambda q: q["number"].cast("int").between(s["low"], s["high"]))


def parse_papers(papers: DataFrame, doc: str = "doc_id", name: str = "file_name", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tests (stage and variant), sections and answered questions of English papers."""
    ready = prepare(papers, doc, name, text)
    tests = ready.select(
        doc, F.coalesce(F.nullif(trim_all(F.regexp_replace(name, r"\.[^.]+\z", "")), F.lit("")), F.lit("Imported English Test")).alias("name"),
        stage_of(F.col(name), F.col("body")).alias("stage"), variant_of(F.col(name), F.col("body")).alias("exam_variant"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("source_format"))
    tree, keys = paper_tree(F.col("body"), F.col("is_cet")), answer_keys(F.col("body"), F.col("is_cet"))
    # Outer explodes: an inner one makes Spark work its input out twice more to filter out empty arrays beforehand.
    rows = ready.select(doc, F.posexplode_outer(tree).alias("pos", "s")).where("s is not null")
    sections = rows.select(doc, "pos", "s.section_id", "s.kind", "s.title", "s.part", "s.mode", "s.passage",
                           F.size("s.questions").cast("bigint").alias("questions"))

    def answered(ks: Column) -> Column:
        numbers = F.transform(ks, lambda k: k["number"])  # of three digits at most, so the list is short however long the paper

        def one(q: Column, at: Column, s: Column, pos: Column, ns: Column) -> Column:
            return bind(F.get(ks, F.array_position(ns, q["number"]).cast("int") - 1), lambda key: F.struct(
                pos.alias("pos"), s["section_id"].alias("section_id"), s["kind"].alias("kind"), at.alias("q_pos"), q["number"].alias("number"),
                q["stem"].alias("stem"), q["options"].alias("options"), F.coalesce(key["answer"], q["located"]).alias("answer"),
                key["explanation"].alias("explanation")))

        return bind(numbers, lambda ns: F.flatten(F.transform(tree, lambda s, pos: F.transform(
            s["questions"], lambda q, at: one(q, at, s, pos, ns)))))

    asked = ready.select(doc, F.explode_outer(bind(keys, answered)).alias("q")).where("q is not null")
    questions = asked.select("q.number", doc, "q.pos", "q.section_id", "q.kind", "q.q_pos", "q.stem", "q.options", "q.answer", "q.explanation")
    return tests, sections, questions


# -- structured responses ------------------------------------------------------------------------

RESPONSE = (f"struct<name:string,stage:string,examVariant:string,warnings:array<string>,sections:array<struct<kind:string,title:string,part:string,"
            f"directions:string,passage:string,questions:array<struct<number:string,stem:string,options:{OPTION},answer:string,explanation:string>>>>>")


def clean_text(value: Column) -> Column:
    text = F.translate(F.coalesce(value, F.lit("")), "\r", "")
    return trim_all(F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{4,}", "\n\n\n"))


def structured_papers(responses: DataFrame, key: str = "doc_id", file_name: str = "file_name", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Sections and questions of structured English responses, cleaned; every section, question and option is kept."""
    plain = F.regexp_replace(F.regexp_replace(content, rf"(?i)\A```(?:json)?{V.WS}*", ""), rf"(?i){V.WS}*```\z", "")
    parsed = responses.withColumn("r", F.from_json(F.regexp_extract(plain, r"(\{[\s\S]*\})", 1), RESPONSE))
    name = F.col(file_name)
    stage = F.when(F.col("r.stage").isin(V.STAGES), F.col("r.stage")).otherwise(
        F.when(name.rlike(r"(?i)考研|研究生|postgraduate|english\s*i(?![A-Za-z0-9_])"), "postgraduate")
        .when(name.rlike("(?i)ielts|雅思"), "ielts").when(name.rlike("(?i)toefl|托福"), "toefl").otherwise(V.STAGES[0]))
    rows = parsed.select(key, stage.alias("stage"), F.posexplode("r.sections").alias("i", "s"))
    kind = clean_text(F.col("s.kind"))
    rows = rows.withColumn("kind", kind).where(F.col("kind").isin(V.ENGLISH_KINDS))
    rows = rows.withColumn("section_id", F.concat(F.lit("ai-"), (F.col("i") + 1).cast("string"), F.lit("-"), "kind"))
    given, passage = clean_text(F.col("s.directions")), clean_text(F.col("s.passage"))
    leaked = rf"(?i)\A{V.WS}*(Directions?{V.WS}*:[\s\S]*?)(?:\n{V.WS}*\n+)([\s\S]+)\z"
    rows = rows.withColumn("_d", given).withColumn("_p", passage)
    leak = (F.col("_d") == "") & F.col("_p").rlike(leaked)
    rows = rows.withColumn("directions", F.when(leak, clean_text(F.regexp_extract("_p", leaked, 1))).otherwise(F.col("_d")))
    rows = rows.withColumn("passage", F.when(leak, clean_text(F.regexp_extract("_p", leaked, 2))).otherwise(F.col("_p")))
    rows = rows.withColumn("passage", F.when((F.col("directions") != "") & F.startswith("passage", F.col("directions")),
                                             trim_all(F.expr("substring(passage, length(directions) + 1)"))).otherwise(F.col("passage")))
    from gradeloom.functions.answers import options_first_wins

    def option(o: Column) -> Column:
        return F.struct(F.regexp_extract(F.upper(F.coalesce(o["label"], F.lit(""))), "[A-O]", 0).alias("label"), clean_text(o["text"]).alias("text"))

    def one(q: Column, i: Column) -> Column:
        number = F.coalesce(F.nullif(clean_text(q["number"]), F.lit("")), (i + 1).cast("string"))
        options = options_first_wins(F.filter(F.transform(F.coalesce(q["options"], F.array().cast(OPTION)), option),
                                              lambda o: (o["label"] != "") & (o["text"] != "")))
        letter = F.regexp_extract(F.upper(clean_text(q["answer"])), "[A-O]", 0)
        return bind(options, lambda os: F.struct(
            number.alias("number"), clean_text(q["stem"]).alias("stem"), os.alias("options"),
            F.when(F.exists(os, lambda o: o["label"] == letter), letter).alias("answer"),
            F.nullif(clean_text(q["explanation"]), F.lit("")).alias("explanation")))

    listed = F.filter(F.transform("s.questions", one), lambda q: (q["stem"] != "") | (F.size(q["options"]) > 0))
    rows = rows.withColumn("questions", F.coalesce(listed, F.array().cast(
        f"array<struct<number:string,stem:string,options:{OPTION},answer:string,explanation:string>>")))
    rows = rows.where((F.col("passage") != "") | (F.size("questions") > 0) | F.col("kind").isin("writing", "translation"))
    title = F.coalesce(F.nullif(clean_text(F.col("s.title")), F.lit("")), F.concat(F.initcap("kind"), F.lit(" Practice")))
    sections = rows.select(key, "stage", "i", "section_id", "kind", title.alias("title"),
                           F.nullif(clean_text(F.col("s.part")), F.lit("")).alias("part"),
                           F.nullif("directions", F.lit("")).alias("directions"), "passage")
    questions = rows.select(key, "section_id", F.posexplode("questions").alias("q_pos", "q")).select(
        key, "section_id", "q_pos", "q.number", F.when(F.col("q.stem") == "", F.concat(F.lit("Blank "), "q.number")).otherwise(F.col("q.stem")).alias("stem"),
        "q.options", "q.answer", "q.explanation")
    return sections, questions
