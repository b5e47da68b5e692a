"""Reading practice: highlights, passages, vocabulary, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom import fixed as V
from gradeloom.functions.text import bind, trim_all, words
from gradeloom.operators.learn import percent
from gradeloom.plans.scale import running


# -- highlights -----------------------------------------------------------------------

def merge_intervals(spans: DataFrame, keys: list[str], start: str, end: str, block: Column) -> DataFrame:
    """Overlapping or touching spans joined.  ``block`` must not decrease with ``start``.

    Spans are joined inside each block first; only one row per block is ordered over
    the whole key.
    """
    slot = [*keys, "_block"]
    local = Window.partitionBy(*slot).orderBy(start, end)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.select(*keys, start, end, block.alias("_block")).withColumn("_reach", F.max(end).over(earlier))
    opens = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    islands = (rows.withColumn("_open", F.last(opens, True).over(so_far))
               .groupBy(*slot, F.col("_open").alias(start)).agg(F.max(end).alias(end)))

    # Blocks of a key, in order: how far earlier blocks reach and which island is open there.
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = islands.groupBy(*slot).agg(F.max(end).alias("_end"), F.max(start).alias("_last"))
    blocks = blocks.withColumn("_carry", F.max("_end").over(before))
    opened = F.when(F.col("_carry").isNull() | (F.col("_last") > F.col("_carry")), F.col("_last"))
    blocks = blocks.withColumn("_opened", F.last(opened, True).over(before)).select(*slot, "_carry", "_opened")
    joined = islands.join(blocks, slot)
    begin = F.when(F.col("_carry").isNull() | (F.col(start) > F.col("_carry")), F.col(start)).otherwise(F.col("_opened"))
    return joined.groupBy(*keys, begin.alias(start)).agg(F.max(end).alias(end))


def split_segments(documents: DataFrame, merged: DataFrame, doc: str, text: str, start: str, end: str) -> DataFrame:
    """Document text cut into highlighted and plain pieces around merged spans.

    Merged spans of a document lie apart, so there are at most as many as its text has characters, and they
    travel to the text as one array.
    """
    spans = merged.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(
        F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")))).alias("_spans"))

    def piece(low: Column, high: Column, highlighted: bool) -> Column:
        return F.struct(low.alias("s"), high.alias("e"), F.lit(highlighted).alias("highlighted"))
    zero = F.lit(0).cast("bigint")
    found = F.coalesce("_spans", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    around = bind(found, lambda spans: F.concat(
        F.flatten(F.transform(spans, lambda x, i: F.array(piece(F.coalesce(F.get(spans, i - 1)["e"], zero), x["s"], False), piece(x["s"], x["e"], True)))),
        F.array(piece(F.coalesce(F.try_element_at(spans, F.lit(-1))["e"], zero), F.length(text).cast("bigint"), False))))
    cut = documents.select(doc, text).join(spans, doc, "left").select(doc, text, F.explode(F.filter(around, lambda p: p["s"] < p["e"])).alias("p"))
    return cut.select(doc, F.col("p.s").alias("start"), F.col("p.e").alias("end"), "p.highlighted", F.substring(
        F.col(text), F.col("p.s").cast("int") + 1, (F.col("p.e") - F.col("p.s")).cast("int")).alias("piece")).where("piece <> ''")


def passage_labels(sections: DataFrame, test: str, pos: str, kind: str, value: str = "reading") -> DataFrame:
    """"Passage A/B/..." from the running count of reading sections."""
    rows = running(sections, [test], F.floor(F.col(pos) / 1024), [pos],
                   {"_count": ("sum", (F.col(kind) == value).cast("int"))})
    letter = F.char(F.lit(65) + F.greatest(F.lit(0), F.col("_count") - 1))
    return rows.withColumn("label", F.concat(F.lit("Passage "), letter)).drop("_count")


# -- vocabulary --------------------------------------------------------------------------

def word_counts(documents: DataFrame, keys: list[str], text: str) -> DataFrame:
    tokens = documents.select(*keys, F.explode(words(F.col(text))).alias("w"))
    return tokens.groupBy(*keys, F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def look_up(counts: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Meaning of each word, or the default text; the first dictionary entry of a word wins."""
    first = dictionary.groupBy(word).agg(F.min_by("meaning", "added").alias("meaning"))
    return counts.join(first, word, "left").withColumn("meaning", F.coalesce("meaning", F.lit(V.NO_MEANING)))


# -- responses ------------------------------------------------------------------------------

def response_state(choice: Column, submitted: Column, answer: Column) -> Column:
    known = F.coalesce(answer, F.lit("")) != ""
    return F.when(submitted, F.when(~known, "unscored").when(choice == answer, "correct").otherwise("wrong"))


def reused_labels(responses: DataFrame, keys: list[str], choice: str, question: str) -> DataFrame:
    """Labels that one learner gave to more than one blank of a section."""
    used = responses.where(F.coalesce(choice, F.lit("")) != "")
    return used.groupBy(*keys, choice).agg(F.count_distinct(question).alias("blanks")).where("blanks > 1")


def answer_order(questions: DataFrame, section: str, number: str, answer: str) -> DataFrame:
    """``n-answer`` of a section's questions in number order (a section holds 100 at most)."""
    entry = F.concat_ws("-", F.col(number).cast("string"), F.coalesce(F.nullif(answer, F.lit("")), F.lit("?")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(number), entry.alias("t"))))
    return questions.groupBy(section).agg(F.array_join(F.transform(rows, lambda r: r["t"]), " · ").alias("answer_order"))


def has_practice(responses: Column, drafts: Column) -> Column:
    """Any choice made or any non-blank draft."""
    chosen = F.exists(F.map_values(responses), lambda r: F.coalesce(r["choice"], F.lit("")) != "")
    written = F.exists(F.map_values(drafts), lambda d: trim_all(d) != "")
    return F.coalesce(chosen, F.lit(False)) | F.coalesce(written, F.lit(False))


def coverage(questions: DataFrame, test: str, section: str, answer: str) -> DataFrame:
    """Sections, questions, answered questions and coverage per test."""
    per_section = questions.groupBy(test, section).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(answer, F.lit("")) != "").alias("a"))
    return per_section.groupBy(test).agg(
        F.count(F.lit(1)).alias("sections"), F.sum("n").alias("questions"), F.sum("a").alias("answered"),
    ).withColumn("coverage", percent(F.col("answered"), F.col("questions")))


def wants_companion(covered: DataFrame, paired: Column) -> DataFrame:
    """Tests imported without an answer file whose coverage stays under 75 per cent."""
    return covered.where(~paired & (F.col("coverage") < 75))


def counters(records: DataFrame, key: str) -> DataFrame:
    """Non-blank notes and drafts waiting for an answer."""
    return records.groupBy(key).agg(
        F.count_if(trim_all(F.coalesce("note", F.lit(""))) != "").alias("notes"),
        F.count_if((F.size("draft_answer") > 0) & (F.size("answer") == 0)).alias("drafts_pending"))
