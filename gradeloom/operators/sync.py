"""Merging learner records from several devices.

A ledger is a long table ``user_id, question_id, field, value, updated_at, seq``.
A null value is a reset (tombstone); an absent row was never set.  ``seq`` is the
order in which devices are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom import fixed as V
from gradeloom.functions.text import bind
from gradeloom.plans.scale import keep_top

KEY = ["user_id", "question_id", "field"]
FIELDS = ["progress", "firstProgress", "favorite", "note"]


# -- normalising ------------------------------------------------------------------

def normalize_ledger(states: DataFrame, payload: str = "payload") -> DataFrame:
    """Long ledger rows from JSON states ``user_id, seq, payload``.

    Invalid fields are dropped, bad timestamps become 1 and the legacy maps fill
    whatever the ledger does not set.
    """
    shape = ("recordLedger map<string,map<string,string>>, progress map<string,string>, "
             "firstProgress map<string,string>, favorites array<string>, notes map<string,string>")
    base = states.select("user_id", "seq", F.from_json(payload, shape).alias("s"))

    def row(question: Column, field: Column, value: Column, entry: Column, prio: int) -> Column:
        return F.struct(question.alias("question_id"), field.alias("field"), value.alias("value"),
                        entry.alias("entry"), F.lit(prio).alias("prio"))

    def legacy(column: str, field: str, prio: int) -> Column:
        return F.transform(F.map_entries(f"s.{column}"), lambda e: row(
            e["key"], F.lit(field), e["value"], F.lit(None).cast("string"), prio))

    ledger = F.flatten(F.transform(F.map_entries("s.recordLedger"), lambda q: F.transform(
        F.map_entries(q["value"]), lambda f: row(q["key"], f["key"], F.lit(None).cast("string"), f["value"], 0))))
    favourites = F.transform("s.favorites", lambda q: row(
        q, F.lit("favorite"), F.lit("true"), F.lit(None).cast("string"), 1))
    # One pass: every source of records becomes one array, ledger entries first.
    empty = F.array().cast("array<struct<question_id:string,field:string,value:string,entry:string,prio:int>>")
    sources = [ledger, legacy("progress", "progress", 1), legacy("firstProgress", "firstProgress", 1),
               legacy("progress", "firstProgress", 2), favourites, legacy("notes", "note", 1)]
    rows = base.select("user_id", "seq", F.explode(F.concat(*[F.coalesce(a, empty) for a in sources])).alias("r"))
    rows = rows.select("user_id", "seq", "r.*", F.try_parse_json("r.entry").alias("v")).where(F.col("field").isin(FIELDS))

    kind = F.schema_of_variant(F.try_variant_get(F.col("v"), "$.value", "variant"))
    text = F.try_variant_get(F.col("v"), "$.value", "string")
    stamp = F.try_variant_get(F.col("v"), "$.updatedAt", "double")
    stamp_kind = F.schema_of_variant(F.try_variant_get(F.col("v"), "$.updatedAt", "variant"))
    numeric = ~stamp_kind.isin("STRING", "BOOLEAN", "VOID") & (stamp >= 0)
    is_result = F.col("field").isin("progress", "firstProgress")
    entry_ok = (F.when(is_result, (kind == "VOID") | ((kind == "STRING") & text.isin("correct", "wrong")))
                .when(F.col("field") == "favorite", kind == "BOOLEAN").otherwise(kind.isin("VOID", "STRING")))
    entry_ok = entry_ok & (F.col("question_id") != "") & (F.length("question_id") <= V.LEDGER_ID_MAX)
    legacy_ok = (F.when(is_result, F.col("value").isin("correct", "wrong"))
                 .when(F.col("field") == "favorite", F.col("question_id") != "").otherwise(F.col("value") != ""))
    in_ledger = F.col("prio") == 0
    valid = rows.where(F.when(in_ledger, entry_ok).otherwise(legacy_ok)).select(
        "user_id", "seq", "question_id", "field", F.when(in_ledger, text).otherwise(F.col("value")).alias("value"),
        F.when(in_ledger & numeric, stamp).otherwise(V.LEGACY_TIMESTAMP).cast("bigint").alias("updated_at"), "prio")
    return keep_top(valid, ["user_id", "seq", "question_id", "field"], [F.col("prio"), F.col("value")]).drop("prio")


# -- merging -----------------------------------------------------------------------

def _tie_order() -> list[Column]:
    """Later stamp first; ties: a value beats a reset, favourite true, longer note, later seq."""
    return [
        F.col("updated_at").desc(),
        F.col("value").isNotNull().desc(),
        (F.when(F.col("field") == "favorite", F.when(F.col("value") == "true", 1).otherwise(0))
         .when(F.col("field") == "note", F.length("value")).otherwise(0)).desc(),
        F.col("seq").desc(),
        F.col("value").desc(),
    ]


def merge_latest(ledger: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Last writer wins for progress, favourite and note over any number of devices."""
    return keep_top(ledger.where(F.col("field") != "firstProgress"), keys, _tie_order())


def first_result(ledger: DataFrame, keys: list[str], order: list[str] | None = None,
                 value: str = "value", updated_at: str = "updated_at") -> DataFrame:
    """The locked first result, independent of merge order.

    With R the last reset, it is the earliest result after R (a tie counts as
    wrong), or the reset itself when nothing follows it.  Resets are aggregated to
    one row per key; one exchange on the key serves the join and the final aggregate.
    """
    order = order or [updated_at]
    at = F.struct(*[F.col(c) for c in order])
    is_reset = F.col(value).isNull()
    resets = ledger.where(is_reset).groupBy(*keys).agg(F.max(at).alias("_reset"))
    rows = ledger.select(*keys, value, updated_at, at.alias("_at"))
    alive = (rows.join(resets, keys, "left")
             .where(F.col("_reset").isNull() | (F.col("_at") > F.col("_reset"))
                    | (is_reset & (F.col("_at") == F.col("_reset")))))
    # results after the reset come before the reset itself; on a tie, wrong comes first
    best = F.min_by(F.struct(F.col(value), F.col(updated_at)),
                    F.struct(is_reset.cast("int"), F.col("_at"), F.when(F.col(value) == "wrong", 0).otherwise(1)))
    return alive.groupBy(*keys).agg(best.alias("_best")).select(*keys, f"_best.{value}", f"_best.{updated_at}")


def fold_first(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The first result as the two-way rule gives it, folded over the devices in ``seq`` order.

    The rule is not associative, so this can differ from ``first_result``.  A key has one row per device.
    """
    rows = ledger.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "updated_at", "value"))).alias("_rows"))

    def entry(value: Column, at: Column) -> Column:
        return F.struct(value.alias("value"), at.alias("updated_at"))

    def step(a: Column, b: Column) -> Column:
        av, bv, at, bt = a["value"], b["value"], a["updated_at"], b["updated_at"]
        reset = F.when(at > bt, av).when(bt > at, bv)
        older = F.when(at < bt, av).when(bt < at, bv).when(av == "wrong", av).otherwise(bv)
        either = av.isNull() | bv.isNull()
        return entry(F.when(either, reset).otherwise(older), F.when(either, F.greatest(at, bt)).otherwise(F.least(at, bt)))
    start = entry(F.get("_rows", F.lit(0))["value"], F.get("_rows", F.lit(0))["updated_at"])
    best = F.aggregate(F.slice("_rows", F.lit(2), F.size("_rows")), start, step)
    return rows.select(*keys, best.alias("_best")).select(*keys, "_best.value", "_best.updated_at")


def merge_ledgers(ledger: DataFrame) -> DataFrame:
    """All four fields of any number of devices merged into one ledger."""
    firsts = first_result(ledger.where(F.col("field") == "firstProgress"), KEY)
    return merge_latest(ledger).select(*KEY, "value", "updated_at").unionByName(
        firsts.select(*KEY, "value", "updated_at"))


def merge_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stored state and one incoming state, field by field, with the two-way rules."""
    a = left.select(*KEY, F.struct("value", F.col("updated_at").alias("at")).alias("l"))
    b = right.select(*KEY, F.struct("value", F.col("updated_at").alias("at")).alias("r"))
    both = a.join(b, KEY, "full")
    lv, rv, la, ra = F.col("l.value"), F.col("r.value"), F.col("l.at"), F.col("r.at")
    left_longer = F.length(lv) > F.length(rv)
    tie = (F.when(F.col("field") == "progress", F.coalesce(rv, lv))
           .when(F.col("field") == "favorite",
                 F.when((lv == "true") | (rv == "true"), F.lit("true")).otherwise(F.lit("false")))
           .otherwise(F.when(lv.isNull(), rv).when(rv.isNull() | left_longer, lv).otherwise(rv)))
    newer = F.when(la > ra, lv).when(ra > la, rv).otherwise(tie)
    any_reset = lv.isNull() | rv.isNull()
    older = (F.when(la < ra, lv).when(ra < la, rv)
             .otherwise(F.when((lv == "wrong") | (rv == "wrong"), F.lit("wrong")).otherwise(F.lit("correct"))))
    reset_wins = F.when(la > ra, lv).when(ra > la, rv).otherwise(F.lit(None))
    is_first = F.col("field") == "firstProgress"
    value = F.when(is_first & any_reset, reset_wins).when(is_first, older).otherwise(newer)
    stamp = F.when(is_first & ~any_reset, F.least(la, ra)).otherwise(F.greatest(la, ra))
    return both.select(
        *KEY,
        F.when(F.col("l").isNull(), rv).when(F.col("r").isNull(), lv).otherwise(value).alias("value"),
        F.when(F.col("l").isNull(), ra).when(F.col("r").isNull(), la).otherwise(stamp).alias("updated_at"))


def stamp_ledger(stamps: DataFrame) -> DataFrame:
    """Fold change events in ``seq`` order; the first result is only set while empty."""
    latest = keep_top(stamps.where(F.col("field") != "firstProgress"), KEY, [F.col("seq").desc()])
    firsts = first_result(stamps.where(F.col("field") == "firstProgress"), KEY, ["seq"])
    return latest.select(*KEY, "value", "updated_at").unionByName(firsts.select(*KEY, "value", "updated_at"))


def materialize(ledger: DataFrame) -> DataFrame:
    """One row per learner and question with the visible records."""
    def pick(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("value")))
    wide = ledger.groupBy("user_id", "question_id").agg(
        pick("progress").alias("progress"), pick("firstProgress").alias("first_progress"),
        (F.coalesce(pick("favorite"), F.lit("false")) == "true").alias("favorite"),
        F.nullif(pick("note"), F.lit("")).alias("note"))
    return wide.where(F.col("progress").isNotNull() | F.col("first_progress").isNotNull()
                      | F.col("favorite") | F.col("note").isNotNull())


def ledger_diff(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Fields whose value or time differ; empty means the ledgers are equal."""
    a = left.select(*keys, F.struct("value", "updated_at").alias("l"))
    b = right.select(*keys, F.struct("value", "updated_at").alias("r"))
    return a.join(b, keys, "full").where(~F.col("l").eqNullSafe(F.col("r"))).select(
        *keys, F.col("l.value").alias("left_value"), F.col("l.updated_at").alias("left_at"),
        F.col("r.value").alias("right_value"), F.col("r.updated_at").alias("right_at"))


#: Blocks the questions of a bank are cut into for ``reset_bank``, so that a large bank is many tasks' work.
RESET_BLOCKS = 64
#: Questions of a block that are written for one field after the other; a multiple of 8, since Parquet packs values by eights.
RESET_RUN = 512


def reset_bank(ledger: DataFrame, questions: DataFrame, resets: DataFrame) -> DataFrame:
    """Drop the records of reset banks and add tombstones for all their questions.

    ``resets`` holds ``user_id, bank_id, reset_at``; ``questions`` ``bank_id, question_id``.
    Pairs of learners and questions are made behind the last shuffle.  A question's home is the set of its banks: what moves is a row
    per learner, home and block of its questions, and the questions once, as an array a block.  A task writes its blocks one after
    another, and runs of a block's questions for each field in turn, so the same runs come again and again and files of them pack well.
    """
    homes = (questions.where("bank_id is not null")
             .groupBy("question_id").agg(F.sort_array(F.collect_set("bank_id")).alias("_home")))
    banks = homes.select("_home").distinct().select("_home", F.explode("_home").alias("bank_id"))
    hit = resets.join(banks, "bank_id").groupBy("user_id", "_home").agg(F.max("reset_at").alias("updated_at"))
    block = F.pmod(F.xxhash64("question_id"), F.lit(RESET_BLOCKS)).cast("int")
    listed = F.sort_array(F.collect_list("question_id"))
    listed = F.when(F.count_if(F.col("question_id").isNull()) > 0, F.array_append(listed, F.lit(None))).otherwise(listed)
    runs = bind(listed, lambda qs: F.transform(F.sequence(F.lit(1), F.size(qs), F.lit(RESET_RUN)), lambda i: F.slice(qs, i, F.lit(RESET_RUN))))
    blocks = homes.groupBy("_home", block.alias("_block")).agg(runs.alias("_runs")).select("_home", "_block", F.explode("_runs").alias("_questions"))
    tasks = 4 * ledger.sparkSession.sparkContext.defaultParallelism  # few bytes move, but each row of them becomes many
    slots = hit.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(RESET_BLOCKS - 1)))).repartition(tasks, "_home", "_block")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).cast("string").alias("value"))
                       for f, v in (("progress", None), ("firstProgress", None), ("favorite", "false"), ("note", None))])
    tombstones = (slots.join(blocks.hint("merge"), ["_home", "_block"]).select("user_id", "updated_at", "_questions", F.explode(fields).alias("f"))
                  .select("user_id", F.explode("_questions").alias("question_id"), "f.field", "f.value", "updated_at"))
    kept = ledger.join(homes, "question_id", "left").join(hit.select("user_id", "_home"), ["user_id", "_home"], "left_anti")
    return kept.select(*KEY, "value", "updated_at").unionByName(tombstones.select(*KEY, "value", "updated_at"))


def bank_tombstones(resets: DataFrame) -> DataFrame:
    """One row per learner and bank that was reset: the time of the last reset."""
    return resets.groupBy("user_id", "bank_id").agg(F.max("reset_at").alias("reset_at"))


def read_after_resets(ledger: DataFrame, questions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows of a ledger that outlive the resets of their banks, as merging with a tombstone per question would keep them.

    A reset is a row of its learner and bank; it is applied here, when the ledger is read, to all questions the bank
    has now.  A value stamped with the time of the reset outlives it, but a first result does not.
    """
    banked = ledger.join(questions.select("question_id", "bank_id"), "question_id", "left")
    at = banked.join(tombstones, ["user_id", "bank_id"], "left")
    same = (F.col("updated_at") == F.col("reset_at")) & (F.col("field") != "firstProgress") & F.col("value").isNotNull()
    return at.where(F.col("reset_at").isNull() | (F.col("updated_at") > F.col("reset_at")) | same).select(*KEY, "value", "updated_at")


def clear_practice(responses: Column, section: Column) -> Column:
    """Responses without those of one section (keys ``section:number``)."""
    return F.map_filter(responses, lambda k, _: ~F.startswith(k, F.concat(section, F.lit(":"))))


# -- state documents -------------------------------------------------------------

def overlay_puts(puts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Top-level payload keys after a series of puts, one row per learner and key.

    ``puts``: ``user_id, seq, payload map<string,string>``; keys outside the allow-list
    are ignored and the latest put that carries a key sets it.
    """
    allowed = keys or V.STATE_KEYS
    rows = (puts.select("user_id", "seq", F.explode("payload").alias("key", "value"))
            .where(F.col("key").isin(allowed)))
    return keep_top(rows, ["user_id", "key"], [F.col("seq").desc(), F.col("value")])


def versions(puts: DataFrame, user: str = "user_id") -> DataFrame:
    return puts.groupBy(user).agg(F.count(F.lit(1)).alias("version"))


def upsert_state(state: DataFrame, puts: DataFrame, records: DataFrame) -> DataFrame:
    """The stored state of every learner after a series of puts, as one write.

    ``state``: ``user_id, part, key, value, updated_at, version`` as this function returns it (empty at first);
    ``puts`` as for ``overlay_puts``; ``records``: ledger rows the puts carry.  Payload keys are overlaid, records
    are merged with the stored ones field by field, and the version grows by the number of puts; it is 0 for a
    learner with records but no put yet.

    All inputs are one tagged union.  It is reduced to a row per learner, key and stamp in the tasks, and once
    more per learner, where windows find version, resets and the winning stamp; so there are two shuffles.
    """
    none = F.lit(None)
    stored = state.select("user_id", "part", "key", "value", "updated_at", F.when(F.col("part") == "record", F.lit(-1)).cast("bigint").alias("seq"),
                          F.lit(0).cast("bigint").alias("puts"), "version")
    entry = lambda part, key, value, n: F.struct(F.lit(part).alias("part"), key.alias("key"), value.alias("value"), F.lit(n).cast("bigint").alias("puts"))
    carried = F.transform(F.filter(F.map_entries("payload"), lambda e: e["key"].isin(V.STATE_KEYS)), lambda e: entry("payload", e["key"], e["value"], 0))
    counted = F.array(entry("version", F.lit(""), none.cast("string"), 1))
    fresh = puts.select("user_id", "seq", F.explode(F.concat(counted, F.coalesce(carried, F.slice(counted, 1, 0)))).alias("e")).select(
        "user_id", "e.part", "e.key", "e.value", none.cast("bigint").alias("updated_at"), "seq", "e.puts", none.cast("bigint").alias("version"))
    graded = records.select("user_id", F.lit("record").alias("part"), F.concat_ws("\u0001", F.col("question_id").cast("string"), "field").alias("key"),
                            "value", "updated_at", "seq", F.lit(0).cast("bigint").alias("puts"), none.cast("bigint").alias("version"))
    field = F.split_part("key", F.lit("\u0001"), F.lit(2))
    metric = F.when(field == "favorite", F.when(F.col("value") == "true", 1).otherwise(0)).when(field == "note", F.length("value")).otherwise(0)
    newest_put = F.min_by("value", F.struct(-F.coalesce("seq", F.lit(-1)), "value"))
    winner = F.max_by("value", F.struct(F.col("value").isNotNull(), metric, "seq", "value"))
    result = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(F.when(F.col("value") == "wrong", 0).otherwise(1), "value")))
    stamps = stored.unionByName(fresh).unionByName(graded).groupBy("user_id", "part", "key", "updated_at").agg(
        newest_put.alias("put"), winner.alias("latest"), result.alias("result"), F.bool_or(F.col("value").isNull()).alias("is_reset"),
        F.sum("puts").alias("puts"), F.max("version").alias("version"))
    learner, own = Window.partitionBy("user_id"), Window.partitionBy("user_id", "part", "key")
    stamps = stamps.withColumn("version", F.sum("puts").over(learner) + F.coalesce(F.max("version").over(learner), F.lit(0)))
    known = stamps.withColumn("field", field)
    reset = F.max(F.when(F.col("is_reset"), F.col("updated_at"))).over(own)
    # A first result is the earliest after the last reset, else that reset; other records go by the latest stamp.
    is_first = (F.col("part") == "record") & (F.col("field") == "firstProgress")
    alive = F.col("result").isNotNull() & (F.col("_reset").isNull() | (F.col("updated_at") > F.col("_reset")))
    place = F.when(is_first, F.when(alive, F.col("updated_at")).when(F.col("updated_at") == F.col("_reset"), F.lit((1 << 63) - 1))).otherwise(-F.col("updated_at"))
    rows = known.where("part <> 'version'").withColumn("_reset", reset).withColumn("_place", place)
    best = rows.withColumn("_rank", F.row_number().over(own.orderBy(F.col("_place").asc_nulls_last()))).where("_rank = 1")
    value = F.when(F.col("part") == "payload", F.col("put")).when(is_first, F.when(alive, F.col("result"))).otherwise(F.col("latest"))
    return best.select("user_id", "part", "key", value.alias("value"), "updated_at", "version")


def merge_bundle(local: DataFrame, remote: DataFrame, keys: list[str], updated_at: str,
                 tie: str = "local") -> DataFrame:
    """Bank, test or practice entries of two sides; the newer stamp wins.

    ``tie="local"`` for banks and tests, ``"remote"`` for practice records.  A missing
    remote stamp loses to any local one; a missing local stamp always loses.
    ``taken`` tells whether the remote side was merged.
    """
    data = [c for c in local.columns if c not in keys]
    a = local.select(*keys, F.struct(*data).alias("l"))
    b = remote.select(*keys, F.struct(*data).alias("r"))
    both = a.join(b, keys, "full")
    la = F.coalesce(F.col(f"l.{updated_at}"), F.lit(""))
    ra = F.coalesce(F.col(f"r.{updated_at}"), F.lit(""))
    ahead = la >= ra if tie == "local" else la > ra
    local_wins = F.col("l").isNotNull() & (la != "") & ((ra == "") | ahead)
    taken = F.col("r").isNotNull() & ~local_wins
    picked = F.when(taken, F.col("r")).otherwise(F.col("l"))
    return both.select(*keys, picked.alias("p"), taken.alias("taken")).select(*keys, "p.*", "taken")


def admit_banks(banks: DataFrame, user: str, position: str, cap: int | None = None) -> DataFrame:
    """Entries of a bundle with a ``reject_reason``, null for those admitted; no row is dropped.

    ``cap`` rejects entries after the first so many of a user; it is off by default.
    """
    reason = (F.when(F.col("id").isNull(), "no_id").when(F.length("id") > V.BUNDLE_ID_MAX, "long_id")
              .when(~F.coalesce(F.col("questions") >= 1, F.lit(False)), "no_questions")
              .when(F.col("questions") > V.QUESTION_CAP, "too_many_questions"))
    if cap is not None:
        place = F.row_number().over(Window.partitionBy(user).orderBy(position))
        reason = F.coalesce(reason, F.when(place > cap, "beyond_cap"))
    return banks.withColumn("reject_reason", reason)
