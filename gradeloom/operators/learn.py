"""Grading, progress, scores and practice sets.

Attempts are aggregated to one row per learner and question before any join, so a
learner or question with very many attempts is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.answers import grade
from gradeloom.functions.text import bind, trim_all
from gradeloom.operators.blueprint import section_case
from gradeloom.plans.scale import keep_top, numbered


# -- results -----------------------------------------------------------------

def effective_attempts(attempts: DataFrame, mode: str = "mode", revealed: str = "revealed") -> DataFrame:
    """Memorising leaves no record; blind answers count once revealed."""
    return attempts.where(
        (F.col(mode) != "memorize") & ((F.col(mode) != "blind") | F.col(revealed)))


def graded_attempts(attempts: DataFrame, questions: DataFrame, question: str = "question_id",
                    selected: str = "selected") -> DataFrame:
    """Attempts with ``outcome`` correct / wrong / draft; empty selections are dropped."""
    keys = questions.select(F.col("id").alias(question), F.col("answer").alias("_key"))
    return (attempts.where(F.size(selected) > 0).join(keys, question, "left")
            .withColumn("outcome", grade(F.col(selected), F.col("_key"))).drop("_key"))


def first_and_latest(attempts: DataFrame, user: str, question: str, outcome: str,
                     order: list[str], time: str) -> DataFrame:
    """First (locked) and current result of every learner and question."""
    at = F.struct(*[F.col(c) for c in order])
    return attempts.groupBy(user, question).agg(
        F.min_by(outcome, at).alias("first_result"),
        F.max_by(outcome, at).alias("current_result"),
        F.min(time).alias("first_at"),
        F.max(time).alias("latest_at"),
        F.count(F.lit(1)).alias("attempts"),
    )


def regrade(latest: DataFrame, corrections: DataFrame, question: str = "question_id") -> DataFrame:
    """Grade the latest selection again after a key change; the first result stays."""
    fixed = corrections.select(F.col("id").alias(question), F.col("answer").alias("_key"))
    again = grade(F.col("selected"), F.col("_key"))
    return (latest.join(fixed, question, "left")
            .withColumn("current_result",
                        F.when(F.size("_key") > 0, F.coalesce(again, F.col("current_result")))
                        .otherwise(F.col("current_result")))
            .drop("_key"))


def grade_drafts(drafts: DataFrame, patches: DataFrame, known_first: DataFrame | None = None,
                 user: str = "user_id", question: str = "question_id") -> DataFrame:
    """Stamps for drafts whose answer has arrived; first result only where none exists."""
    keys = patches.select(F.col("id").alias(question), F.col("answer").alias("_key"))
    checked = (drafts.where(F.size("selected") > 0).join(keys, question)
               .withColumn("progress", grade(F.col("selected"), F.col("_key")))
               .where(F.col("progress") != "draft").drop("_key"))
    if known_first is None:
        return checked.withColumn("first_progress", F.col("progress"))
    had = known_first.select(user, question).distinct().withColumn("_had", F.lit(True))
    return (checked.join(had, [user, question], "left")
            .withColumn("first_progress", F.when(F.col("_had").isNull(), F.col("progress")))
            .drop("_had"))


def wrong_to_favourites(results: DataFrame, favourites: DataFrame, user: str, question: str,
                        outcome: str = "current_result") -> DataFrame:
    """Favourite stamps for wrong answers that are not favourites yet."""
    return (results.where(F.col(outcome) == "wrong").select(user, question).distinct()
            .join(favourites.select(user, question).distinct(), [user, question], "left_anti"))


# -- progress ------------------------------------------------------------------

def percent(part: Column, whole: Column) -> Column:
    """Half-up whole percentage, 0 when there is nothing to divide."""
    return F.when(whole > 0, F.round(part * 100 / whole)).otherwise(F.lit(0)).cast("bigint")


def progress_stats(results: DataFrame, bank_sizes: DataFrame, user: str, bank: str) -> DataFrame:
    """Answered, correct, wrong, accuracy and progress per learner and bank.

    ``results`` has one row per learner and question with ``current_result``.
    """
    stats = results.groupBy(user, bank).agg(
        F.count_if(F.col("current_result").isin("correct", "wrong")).alias("answered"),
        F.count_if(F.col("current_result") == "correct").alias("correct"),
        F.count_if(F.col("current_result") == "wrong").alias("wrong"),
    )
    return stats.join(bank_sizes.select(bank, F.col("questions").alias("_n")), bank).select(
        user, bank, "answered", "correct", "wrong",
        percent(F.col("correct"), F.col("answered")).alias("accuracy"),
        F.least(F.lit(100), percent(F.col("answered"), F.greatest(F.col("_n"), F.lit(1)))).alias("progress"),
    )


def type_counts(questions: DataFrame, bank: str) -> DataFrame:
    return questions.groupBy(bank).agg(
        F.count_if(~F.col("multiple")).alias("single"),
        F.count_if(F.col("multiple")).alias("multiple"),
        F.count(F.lit(1)).alias("all"),
    )


def scope_counts(records: DataFrame, questions: DataFrame, user: str, bank: str, group: str,
                 question: str, single_only: bool = False) -> DataFrame:
    """all / unanswered / wrong / favourite of each learner's active bank.

    ``records`` is one row per learner and question they touched, with
    ``active_bank``, ``active_group``, ``current_result`` and ``favourite``.  Unanswered is
    bank size minus answered, so untouched pairs are never listed; wrong looks at
    the whole group.
    """
    if single_only:
        questions = questions.where(~F.col("multiple"))
    sizes = questions.groupBy(F.col(bank).alias("active_bank")).agg(F.count(F.lit(1)).alias("_n"))
    touched = records.join(questions.select(question, bank, group), question)
    own = F.col(bank) == F.col("active_bank")
    result = F.col("current_result")
    counts = touched.groupBy(user, "active_bank").agg(
        F.count_if(own & result.isNotNull()).alias("_answered"),
        F.count_if((F.col(group) == F.col("active_group")) & (result == "wrong")).alias("wrong"),
        F.count_if(own & F.col("favourite")).alias("favourite"),
    )
    return counts.join(sizes, "active_bank").select(
        user, "active_bank", F.col("_n").alias("all"),
        (F.col("_n") - F.col("_answered")).alias("unanswered"), "wrong", "favourite")


def reset_impact(records: DataFrame, user: str, bank: str) -> DataFrame:
    """What resetting a bank would clear for each learner."""
    return records.groupBy(user, bank).agg(
        F.count_if(F.col("current_result").isNotNull()).alias("answered"),
        F.count_if(F.col("current_result") == "wrong").alias("wrong"),
        F.count_if(F.col("favourite")).alias("favourites"),
        F.count_if(F.length(trim_all(F.coalesce("note", F.lit("")))) > 0).alias("notes"),
    )


# -- scores ---------------------------------------------------------------------

def with_points(questions: DataFrame, number: str, sections: list[tuple] = V.MODERN_SECTIONS,
                own: str | None = None) -> DataFrame:
    """Points of a question: its own, else the blueprint's, else 0."""
    band = section_case(F.col(number), sections, 3)
    value = band if own is None else F.coalesce(F.col(own), band)
    return questions.withColumn("points", F.coalesce(value.cast("double"), F.lit(0.0)))


def exam_score(first_results: DataFrame, questions: DataFrame, user: str, question: str,
               paper: str) -> DataFrame:
    """Earned, reachable and total points per learner and paper from first results."""
    totals = questions.groupBy(paper).agg(F.sum("points").alias("total"))
    scored = first_results.join(questions.select(question, paper, "points"), question)
    per_user = scored.groupBy(user, paper).agg(
        F.sum(F.when(F.col("first_result") == "correct", F.col("points")).otherwise(0.0)).alias("earned"),
        F.sum("points").alias("answered_maximum"),
    )
    return per_user.join(totals, paper)


# -- practice -----------------------------------------------------------------------

def practice_pool(records: DataFrame, scope: str, single_only: bool = False) -> DataFrame:
    """Touched questions of one scope: wrong, favourite or answered."""
    keep = {"wrong": F.col("current_result") == "wrong",
            "favourite": F.col("favourite"),
            "answered": F.col("current_result").isNotNull()}[scope]
    out = records.where(keep)
    return out.where(~F.col("multiple")) if single_only else out


#: Blocks a bank is cut into for ``unanswered``, so that a large bank is many tasks' work.
BANK_BLOCKS = 64
#: Questions of a block at most, about; more blocks are made where the largest bank needs them.
BLOCK_QUESTIONS = 1024


def unanswered(enrolled: DataFrame, questions: DataFrame, answered: DataFrame, user: str,
               bank: str, question: str) -> DataFrame:
    """Questions of each enrolled bank that the learner has no result for.

    Pairs of learners and questions are made behind the last shuffle: what moves is a row per learner and block of
    the bank, with the answers in that block, and the questions once, as an array a block.  A task writes its blocks one after
    another, each in the same order for all its learners, so nearly the same run of questions comes again and again and files of it pack well.
    """
    banked = questions.select(bank, question).where(F.col(question).isNotNull())
    most = banked.groupBy(bank).count().agg(F.max("count")).first()[0] or 0
    count = max(BANK_BLOCKS, most // BLOCK_QUESTIONS)
    block = F.pmod(F.xxhash64(question), F.lit(count)).cast("int")
    blocks = banked.groupBy(bank, block.alias("_block")).agg(F.sort_array(F.collect_list(question)).alias("_all"))
    even = F.size("_all") - F.size("_all") % 8  # Parquet packs values by eights: a run repeats byte by byte if it has whole ones
    halves = F.array(F.slice("_all", F.lit(1), even), F.slice("_all", even + 1, F.lit(8)))
    blocks = blocks.select(bank, "_block", F.posexplode(halves).alias("_half", "_questions"))
    slots = enrolled.select(user, bank).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    done = answered.select(user, question).groupBy(user, block.alias("_block")).agg(F.collect_set(question).alias("_done"))
    slots = slots.join(done, [user, "_block"], "left").withColumn("_half", F.explode(F.array(F.lit(0), F.lit(1))))
    tasks = 4 * enrolled.sparkSession.sparkContext.defaultParallelism  # few bytes move, but each row of them becomes many
    rows = slots.repartition(tasks, bank, "_block", "_half").join(blocks.hint("merge"), [bank, "_block", "_half"])
    left = F.when(F.col("_done").isNull(), F.col("_questions")).otherwise(
        F.filter("_questions", lambda q: ~F.array_contains("_done", q)))
    # Outer: an inner explode would work the array out again to filter empty ones beforehand.
    return rows.select(user, bank, F.explode_outer(left).alias(question)).where(F.col(question).isNotNull())


#: Bits of a bitmap that ``bitmap_construct_agg`` makes.
BITMAP_BITS = 32_768


def bank_places(questions: DataFrame, bank: str, question: str, block: Column) -> DataFrame:
    """Questions with their 0-based ``place`` in the bank; ``block`` must not decrease with the question."""
    return numbered(questions.select(bank, question), [bank], block, [question], "place").withColumn("place", F.col("place") - 1)


def answered_bitmaps(answered: DataFrame, places: DataFrame, user: str, bank: str, question: str) -> DataFrame:
    """(user, bank, bucket, bits): which places of a bank a learner has a result for.

    A bit a question instead of a row: the table grows with learners and their banks.
    """
    marked = answered.select(user, question).join(places, question)
    bucket = F.floor(F.col("place") / BITMAP_BITS)
    return marked.groupBy(user, bank, bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BITMAP_BITS))).alias("bits"))


def unanswered_counts(enrolled: DataFrame, places: DataFrame, bitmaps: DataFrame, user: str, bank: str) -> DataFrame:
    """(user, bank, questions, unanswered) of every enrolled bank, from the bitmaps alone."""
    sizes = places.groupBy(bank).agg(F.count(F.lit(1)).alias("questions"))
    done = bitmaps.groupBy(user, bank).agg(F.sum(F.bitmap_count("bits")).alias("_done"))
    return (enrolled.select(user, bank).distinct().join(sizes, bank).join(done, [user, bank], "left")
            .select(user, bank, "questions", (F.col("questions") - F.coalesce("_done", F.lit(0))).alias("unanswered")))


def next_unanswered(enrolled: DataFrame, places: DataFrame, bitmaps: DataFrame, user: str, bank: str, question: str, k: int) -> DataFrame:
    """The first ``k`` unanswered questions of each enrolled bank, in the bank's order.

    A bitmap gives at most ``k`` free places, which lie in its first ``k`` bytes with a free bit; full bytes in front of one
    are passed over in a single match, so a learner costs ``k`` steps however long the bank.  Only the places meet the questions.
    """
    buckets = places.groupBy(bank, F.floor(F.col("place") / BITMAP_BITS).alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    rows = enrolled.select(user, bank).distinct().join(buckets, bank).join(bitmaps, [user, bank, "bucket"], "left")

    def free(byte: Column, i: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda bit: F.call_function("shiftright", byte, bit).bitwiseAND(1) == 0), lambda bit: i * 8 + bit)
    byte = lambda i: F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int")

    def step(acc: Column, marks: Column) -> Column:
        rest = F.substring(marks, acc["at"] * 2 + 1, F.length(marks))
        return bind(acc["at"] + (F.length(F.regexp_extract(rest, r"\A(?:FF)*+", 0)) / 2).cast("int"), lambda at: F.struct(
            (at + 1).alias("at"), F.when(at * 2 < F.length(marks), F.concat(acc["open"], F.array(at))).otherwise(acc["open"]).alias("open")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"))
    steps = F.sequence(F.lit(1), F.lit(min(k, BITMAP_BITS // 8)))
    opened = bind(F.hex("bits"), lambda marks: F.aggregate(steps, start, lambda acc, _: step(acc, marks), lambda acc: acc["open"]))
    first = F.when(F.col("bits").isNull(), F.sequence(F.lit(0), F.lit(min(k, BITMAP_BITS) - 1))).otherwise(
        F.flatten(F.transform(opened, lambda i: bind(byte(i), lambda b: free(b, i)))))
    few = F.slice(F.filter(first, lambda p: p < F.col("_n")), 1, k)
    # Outer: an inner explode would work the array out again to filter empty ones beforehand.
    found = rows.select(user, bank, F.explode_outer(F.transform(few, lambda p: p + F.col("bucket") * BITMAP_BITS)).alias("place")).where("place is not null")
    return keep_top(found, [user, bank], [F.col("place")], k).join(places, [bank, "place"]).select(user, bank, question, "place")


def draw_rank(user: Column, question: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), user.cast("string"), question.cast("string")))


def draw(pool: DataFrame, user: str, question: str, k: int, seed: str) -> DataFrame:
    """``k`` pseudo-random questions per learner, the same for the same seed."""
    hashed = pool.withColumn("_draw", draw_rank(F.col(user), F.col(question), seed))
    return keep_top(hashed, [user], [F.col("_draw"), F.col(question)], k, rank="pick").drop("_draw")


def draw_from_bank(enrolled: DataFrame, questions: DataFrame, user: str, bank: str, question: str,
                   k: int, seed: str) -> DataFrame:
    """``k`` distinct questions of a whole bank per learner without listing all pairs.

    Each bank is put in hash order once; a learner reads ``k`` consecutive slots
    from an offset of their own, so the work is learners x k.
    """
    hashed = questions.select(bank, question).withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(question).cast("string"))))
    slots = numbered(hashed, [bank], F.substring("_h", 1, 3), ["_h", question], "_slot")
    sizes = questions.groupBy(bank).agg(F.count(F.lit(1)).alias("_n"))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(user).cast("string"))), 1, 12),
                    16, 10).cast("bigint")
    wanted = (enrolled.select(user, bank).distinct().join(sizes, bank)
              .withColumn("pick", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("_n")))))
              .withColumn("_slot", F.pmod(offset + F.col("pick"), F.col("_n")) + 1))
    return wanted.join(slots, [bank, "_slot"]).select(user, bank, question, "pick")


def shuffle_options(options: Column, question: Column, seed: str) -> Column:
    """Options in a reproducible random order."""
    tagged = F.transform(options, lambda o: F.struct(
        F.md5(F.concat_ws("|", F.lit(seed), question.cast("string"), o["label"])).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(tagged), lambda t: t["o"])
