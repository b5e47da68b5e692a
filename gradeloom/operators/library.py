"""Banks and tests as a library: normalising, grouping, ordering, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom import fixed as V
from gradeloom.functions.answers import clean_answer, is_multiple
from gradeloom.functions.text import collapse, group_name, group_rule_number, trim_all
from gradeloom.operators.learn import percent


def normalize_questions(questions: DataFrame, bank: str = "bank_id", pos: str = "pos") -> DataFrame:
    """Clean answers, the multiple flag and ids of the form ``bank:position``."""
    answer = clean_answer(F.col("answer"))
    return (questions.withColumn("answer", answer)
            .withColumn("multiple", is_multiple(F.col("question_type"), F.col("answer")))
            .withColumn("id", F.coalesce(F.nullif("id", F.lit("")),
                                         F.concat_ws(":", F.col(bank).cast("string"), F.col(pos).cast("string")))))


def suggest_groups(banks: DataFrame, questions: DataFrame, bank: str, name: str, pos: str,
                   category: str, stem: str) -> DataFrame:
    """Suggested group of every bank: the first rule that its name or any of its questions matches.

    Every question is judged in its own row; a bank is the minimum over its questions, so no bank is collected.
    """
    rule = questions.select(bank, group_rule_number(F.concat_ws(" ", category, stem)).alias("_rule")).groupBy(bank).agg(F.min("_rule").alias("_rule"))
    best = F.least(group_rule_number(F.col(name)), F.coalesce("_rule", F.lit(len(V.GROUP_RULES))))
    names = F.array(*[F.lit(n) for n, _ in V.GROUP_RULES], F.lit(""))
    return banks.join(rule, bank, "left").withColumn("suggested_group", F.get(names, best)).drop("_rule")


def normalize_banks(banks: DataFrame, suggested: str | None = None) -> DataFrame:
    """Trimmed names and descriptions, collapsed groups.

    A group that was never given (null) takes the suggestion; an empty one stays empty.
    """
    fallback = F.col(suggested) if suggested else F.lit("")
    name = trim_all(F.coalesce("name", F.lit("")))
    return (banks
            .withColumn("group_name", F.when(F.col("group_name").isNull(), fallback).otherwise(group_name(F.col("group_name"))))
            .withColumn("name", F.when(name == "", F.lit(V.DEFAULT_BANK_NAME)).otherwise(name))
            .withColumn("description", trim_all(F.coalesce("description", F.lit(""))))
            .withColumn("featured", F.coalesce("featured", F.lit(False))))


def bank_rollup(questions: DataFrame, group: str, bank: str) -> DataFrame:
    """Counts per bank, per group and for the library in one pass.

    ``questions`` carries ``multiple``, ``pending`` and ``completed`` flags.
    """
    grouped = questions.groupingSets([[F.col(group), F.col(bank)], [F.col(group)], []], F.col(group), F.col(bank))
    out = grouped.agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("multiple")).alias("single"),
        F.count_if("multiple").alias("multiple"), F.count_if("pending").alias("pending"),
        F.count_if("completed").alias("completed"))
    return out.withColumn("completion", percent(F.col("completed"), F.col("questions")))


def featured(banks: DataFrame) -> DataFrame:
    return banks.where("featured").orderBy(F.col("updated_at").desc(), "id")


def newest_first(rows: DataFrame, key: str = "id", page: int | None = None) -> DataFrame:
    """Entries by import time, newest first; ``page`` gives the first so many, as a listing shows them."""
    out = rows.orderBy(F.col("imported_at").desc(), key)
    return out if page is None else out.limit(page)


def stage_counts(tests: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Tests of one stage and the sizes of the other non-empty stages."""
    return (tests.where(F.col("stage") == stage),
            tests.where(F.col("stage") != stage).groupBy("stage").agg(F.count(F.lit(1)).alias("tests")))


def distinct_values(rows: DataFrame, array: str, name: str) -> DataFrame:
    return rows.select(F.explode(array).alias(name)).distinct()


def with_current_first(saved: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """The unsaved current version first, then every other saved bank."""
    rest = saved.join(current.select(key), key, "left_anti").withColumn("priority", F.lit(1))
    return current.withColumn("priority", F.lit(0)).unionByName(rest)


# -- group order ---------------------------------------------------------------

def normalize_group_order(order: Column) -> Column:
    """Collapsed, non-empty, distinct names."""
    return F.array_distinct(F.filter(F.transform(order, collapse), lambda n: n != ""))


def reconcile_order(saved: Column, available: Column) -> Column:
    """Saved names that still exist, then missing ones in Chinese order, ungrouped last."""
    kept = F.array_intersect(saved, available)
    missing = F.array_except(available, saved)
    named = F.filter(missing, lambda n: n != V.UNGROUPED)
    ranked = F.array_sort(F.transform(named, lambda n: F.struct(F.collate(n, "zh").alias("k"), n.alias("n"))))
    ordered = F.transform(ranked, lambda r: r["n"])
    return F.concat(kept, ordered, F.filter(missing, lambda n: n == V.UNGROUPED))


def group_positions(saved: DataFrame, banks: DataFrame, owner: str) -> DataFrame:
    """Reconciled order as rows.  ``saved``: owner, group_name, position; ``banks``: owner, group_name."""
    have = banks.select(owner, F.coalesce(F.nullif("group_name", F.lit("")), F.lit(V.UNGROUPED)).alias("group_name")).distinct()
    first = saved.groupBy(owner, "group_name").agg(F.min("position").alias("_saved"))
    both = have.join(first, [owner, "group_name"], "left")
    rank = Window.partitionBy(owner).orderBy(
        F.col("_saved").asc_nulls_last(), F.col("group_name") == V.UNGROUPED, F.collate("group_name", "zh"), "group_name")
    return both.withColumn("position", F.row_number().over(rank)).drop("_saved")


def move_by(order: Column, name: Column, offset: int) -> Column:
    """Swap a name with its neighbour; unchanged at the edges."""
    at = F.array_position(order, name)
    to = at + offset
    swapped = F.transform(order, lambda x, i: F.when(i + 1 == at, F.try_element_at(order, to.cast("int")))
                          .when(i + 1 == to, name).otherwise(x))
    return F.when((at < 1) | (to < 1) | (to > F.size(order)), order).otherwise(swapped)


def drop_at(order: Column, name: Column, target: Column) -> Column:
    """Take a name out and insert it at the target's old position."""
    at, to = F.array_position(order, name), F.array_position(order, target)
    rest = F.filter(order, lambda x: x != name)
    moved = F.concat(F.slice(rest, F.lit(1), (to - 1).cast("int")), F.array(name),
                     F.slice(rest, to.cast("int"), F.size(order)))
    return F.when((name == target) | (at < 1) | (to < 1), order).otherwise(moved)


# -- nesting ----------------------------------------------------------------------

def nest_questions(questions: DataFrame, bank: str, pos: str, columns: list[str],
                   part_size: int = V.QUESTION_CAP) -> DataFrame:
    """Questions back to arrays, ``part_size`` per row; larger banks give several parts."""
    part = F.floor(F.col(pos) / part_size).cast("int").alias("part")
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos), *columns)))
    return questions.groupBy(bank, part).agg(packed.alias("questions"))


def listing(rows: DataFrame, keys: list[str], pos: str, text: str, separator: str = "\n",
            part_size: int = 4096) -> DataFrame:
    """Texts joined in position order, ``part_size`` positions per output row."""
    part = F.floor(F.col(pos) / part_size).cast("int").alias("part")
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(text).alias("t"))))
    return rows.groupBy(*keys, part).agg(packed.alias("_rows")).select(
        *keys, "part", F.array_join(F.transform("_rows", lambda r: r["t"]), separator).alias("text"))


def pair_companions(files: DataFrame, batch: str, name: str) -> DataFrame:
    """Source and answer file of batches of exactly two files of which one names answers."""
    tagged = files.select(batch, name, F.col(name).rlike(V.COMPANION_NAME).alias("_answer"))
    return tagged.groupBy(batch).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_answer").alias("_a"),
        F.max(F.when(~F.col("_answer"), F.col(name))).alias("source_file"),
        F.max(F.when(F.col("_answer"), F.col(name))).alias("answer_file"),
    ).where("_n = 2 and _a = 1").drop("_n", "_a")
