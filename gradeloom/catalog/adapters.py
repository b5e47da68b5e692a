"""How the driver's tables play the product's tables.

* ``events``  attempts, favourites and resets: question ``props.k``; purchase = correct,
  click = wrong, error = reset, signup = favourite, view = look only.
* ``part``    questions (bank = brand, group = type, multiple = even size).
* ``conversations`` comments; ``documents`` notes, pages, exam texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.catalog import Tables

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

ATTEMPTS_SQL = f"""
attempts AS (
  SELECT event_id, user_id, {K} AS question_id, ts,
         CASE event_type WHEN 'purchase' THEN 'correct' ELSE 'wrong' END AS outcome
  FROM events WHERE event_type IN ('purchase', 'click'))"""

RECORDS_SQL = ATTEMPTS_SQL + f""",
cur AS (SELECT user_id, question_id, arg_max(outcome, struct_pack(t := ts, i := event_id)) AS current_result
        FROM attempts GROUP BY ALL),
fav AS (SELECT DISTINCT user_id, {K} AS question_id FROM events WHERE event_type = 'signup'),
act AS (SELECT user_id, arg_max({K}, struct_pack(t := ts, i := event_id)) AS active_question FROM events GROUP BY ALL),
active AS (SELECT a.user_id, p.p_brand AS active_bank, p.p_type AS active_group
           FROM act a JOIN part p ON p.p_partkey = a.active_question),
records AS (
  SELECT coalesce(c.user_id, f.user_id) AS user_id, coalesce(c.question_id, f.question_id) AS question_id,
         c.current_result, f.user_id IS NOT NULL AS favourite
  FROM cur c FULL JOIN fav f ON c.user_id = f.user_id AND c.question_id = f.question_id),
recs AS (
  SELECT r.*, a.active_bank, a.active_group, p.p_brand AS bank_id, p.p_type AS group_name, p.p_size % 2 = 0 AS multiple
  FROM records r JOIN active a USING (user_id) JOIN part p ON p.p_partkey = r.question_id)"""


def events(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("question_id"))


def attempts(t: Tables) -> DataFrame:
    return (events(t).where(F.col("event_type").isin("purchase", "click"))
            .withColumn("outcome", F.when(F.col("event_type") == "purchase", "correct").otherwise("wrong")))


def questions(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("bank_id"),
        F.col("p_type").alias("group_name"), (F.col("p_size") % 2 == 0).alias("multiple"),
        F.col("p_name").alias("stem"), "p_size", "p_retailprice")


def current_results(t: Tables) -> DataFrame:
    return attempts(t).groupBy("user_id", "question_id").agg(
        F.max_by("outcome", F.struct("ts", "event_id")).alias("current_result"))


def favourites(t: Tables) -> DataFrame:
    return events(t).where("event_type = 'signup'").select("user_id", "question_id").distinct()


def active_banks(t: Tables) -> DataFrame:
    """Bank and group of each learner's latest event."""
    latest = events(t).groupBy("user_id").agg(F.max_by("question_id", F.struct("ts", "event_id")).alias("question_id"))
    return latest.join(questions(t).select("question_id", "bank_id", "group_name"), "question_id").select(
        "user_id", F.col("bank_id").alias("active_bank"), F.col("group_name").alias("active_group"))


def records(t: Tables) -> DataFrame:
    """One row per learner and touched question, with the learner's active bank."""
    bank = questions(t).select("question_id", "bank_id", "group_name", "multiple")
    touched = events(t).where("event_type in ('purchase', 'click', 'signup')").groupBy("user_id", "question_id").agg(
        F.max_by(F.when(F.col("event_type") == "purchase", "correct").otherwise("wrong"),
                 F.when(F.col("event_type") != "signup", F.struct("ts", "event_id"))).alias("current_result"),
        F.bool_or(F.col("event_type") == "signup").alias("favourite"))
    return touched.join(active_banks(t), "user_id").join(bank, "question_id")
