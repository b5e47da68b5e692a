"""Discussion: comments, likes, reports, moderation, mutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.text import blocked_term, trim_all
from gradeloom.plans.scale import keep_top, running


def distinct_marks(marks: DataFrame, comment: str = "comment_id", user: str = "user_id") -> DataFrame:
    """Likes or reports with one row per comment and user."""
    return marks.select(comment, user).distinct()


def mark_counts(marks: DataFrame, name: str, comment: str = "comment_id", user: str = "user_id") -> DataFrame:
    return distinct_marks(marks, comment, user).groupBy(comment).agg(F.count(F.lit(1)).alias(name))


def distinct_reporters(reports: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return reports.groupBy("comment_id").agg(count.alias("reporters"))


def visible_comments(comments: DataFrame, viewer) -> DataFrame:
    """Published comments and the viewer's own."""
    return comments.where((F.col("status") == "published") | (F.col("user_id") == F.lit(viewer)))


def top_comments(comments: DataFrame, likes: DataFrame, viewer, k: int = 50) -> DataFrame:
    """Newest ``k`` visible comments per question with like counts.

    The cut comes first: likes of other comments are dropped before they are made distinct and counted.
    """
    newest = keep_top(visible_comments(comments, viewer), ["question_id"],
                      [F.col("created_at").desc(), F.col("id").desc()], k)
    counts = mark_counts(likes.join(newest.select(F.col("id").alias("comment_id")), "comment_id", "left_semi"), "likes").withColumnRenamed("comment_id", "id")
    return (newest.join(counts, "id", "left")
            .withColumn("likes", F.coalesce("likes", F.lit(0).cast("bigint")))
            .withColumn("own", F.col("user_id") == F.lit(viewer)))


def moderation_queue(comments: DataFrame, reports: DataFrame, limit: int = 200) -> DataFrame:
    """Pending first, then newest, with report counts; only reports on the page are counted.

    The page, at most ``limit`` rows, is read once and then serves as a table of its own.
    """
    spark = comments.sparkSession
    page = comments.orderBy((F.col("status") == "pending").desc(), F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    page = spark.createDataFrame(page.collect(), page.schema)
    shown = F.broadcast(page.select(F.col("id").alias("comment_id")))
    counts = mark_counts(reports.join(shown, "comment_id", "left_semi"), "reports").withColumnRenamed("comment_id", "id")
    return page.join(counts, "id", "left").withColumn("reports", F.coalesce("reports", F.lit(0).cast("bigint")))


def screen(comments: DataFrame, body: str = "body", terms: list[str] | None = None) -> DataFrame:
    """Initial status and reason from the blocked terms."""
    hit = blocked_term(F.col(body), terms)
    return (comments.withColumn("_hit", hit)
            .withColumn("status", F.when(F.col("_hit").isNotNull(), "pending").otherwise("published"))
            .withColumn("moderation_reason", F.concat(F.lit(V.BLOCKED_REASON), F.col("_hit"))).drop("_hit"))


def admit_comments(posts: DataFrame, users: DataFrame, body: str = "body", question: str = "question_id") -> DataFrame:
    """Posts with trimmed text and a reject reason (null when admitted); too long texts and ids are rejected whole."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    text = trim_all(F.coalesce(body, F.lit("")))
    reason = (F.when(F.col("_known").isNull(), "unknown_user").when(F.col("muted"), "muted")
              .when((F.coalesce(question, F.lit("")) == "") | (F.length(body) < V.COMMENT_MIN), "too_short")
              .when((F.length(body) > V.COMMENT_MAX) | (F.length(question) > V.QUESTION_ID_MAX), "too_long"))
    return (posts.join(known, "user_id", "left").withColumn(body, text)
            .withColumn("reject_reason", reason).drop("_known"))


def clamp_days(days: Column) -> Column:
    return F.least(F.lit(365), F.greatest(F.lit(1), F.coalesce(F.nullif(days, F.lit(0)), F.lit(7))))


def mutes_from_actions(actions: DataFrame, comments: DataFrame) -> DataFrame:
    """Mute timeline of comment authors; a later mute replaces an earlier one."""
    author = comments.select(F.col("id").alias("comment_id"), "user_id")
    return (actions.where("action = 'mute'").select("comment_id", "seq", "ts", "days").join(author, "comment_id")
            .select("user_id", "seq", "ts",
                    (F.col("ts") + F.make_dt_interval(clamp_days(F.col("days")))).alias("muted_until")))


def muted_as_of(posts: DataFrame, mutes: DataFrame, slice_hours: int = 24) -> DataFrame:
    """Posts with ``muted``: the author's latest earlier mute still runs at post time.

    Both sides are one timeline; the latest mute is carried per author and time slice.
    """
    extra = [c for c in posts.columns if c not in ("user_id", "ts", "seq")]
    packed = posts.select("user_id", "ts", "seq", F.lit(1).alias("_kind"), F.struct(*extra).alias("_post"),
                          F.lit(None).cast("timestamp").alias("_until"))
    marks = mutes.select("user_id", "ts", "seq", F.lit(0).alias("_kind"),
                         F.lit(None).cast(packed.schema["_post"].dataType).alias("_post"),
                         F.col("muted_until").alias("_until"))
    block = F.floor(F.unix_micros("ts") / (slice_hours * 3_600_000_000))
    line = running(packed.unionByName(marks), ["user_id"], block, ["ts", "_kind", "seq"],
                   {"_muted_until": ("last", F.col("_until"))})
    return line.where("_kind = 1").select(
        "user_id", "ts", "seq", "_post.*", F.coalesce(F.col("_muted_until") > F.col("ts"), F.lit(False)).alias("muted"))


def third_reporter(reports: DataFrame, threshold: int = V.REPORT_THRESHOLD) -> DataFrame:
    """When the ``threshold``-th distinct reporter arrived, per comment."""
    firsts = reports.groupBy("comment_id", "user_id").agg(F.min("seq").alias("seq"))
    return (keep_top(firsts, ["comment_id"], [F.col("seq")], threshold, rank="n")
            .where(F.col("n") == threshold).select("comment_id", F.col("seq").alias("crossed_at")))


def final_status(comments: DataFrame, reports: DataFrame, actions: DataFrame) -> DataFrame:
    """Status after screening, reports and admin actions, in ``seq`` order.

    Every report from the third distinct reporter on sets pending again; publish and
    hide overwrite.  All parts are per-comment aggregates, so a comment with very
    many reports needs no ordered pass.
    """
    crossing = third_reporter(reports)
    last_report = reports.groupBy("comment_id").agg(F.max("seq").alias("_reported"))
    flagged = last_report.join(crossing, "comment_id").select("comment_id", "_reported")
    admin = (actions.where(F.col("action").isin("publish", "hide"))
             .groupBy("comment_id").agg(F.max_by("action", "seq").alias("_action"), F.max("seq").alias("_acted")))
    out = (comments.join(flagged, comments["id"] == flagged["comment_id"], "left").drop("comment_id")
           .join(admin, comments["id"] == admin["comment_id"], "left").drop("comment_id"))
    acted = F.when(F.col("_action") == "publish", "published").otherwise("hidden")
    report_last = F.col("_reported").isNotNull() & (F.col("_acted").isNull() | (F.col("_reported") > F.col("_acted")))
    return (out.withColumn("status", F.when(report_last, "pending").when(F.col("_acted").isNotNull(), acted)
                           .otherwise(F.col("status")))
            .withColumn("moderation_reason", F.when(F.col("_reported").isNotNull(), F.lit(V.REPORT_REASON))
                        .otherwise(F.col("moderation_reason")))
            .drop("_reported", "_action", "_acted"))


def audit_log(actions: DataFrame) -> DataFrame:
    """Append-only log rows; mutes keep the days as given."""
    detail = F.when(F.col("action") == "mute", F.concat(
        F.coalesce(F.nullif("days", F.lit(0)), F.lit(7)).cast("string"), F.lit(" days")))
    return actions.select("comment_id", "action", detail.alias("detail"), F.col("ts").alias("created_at"),
                          F.to_date("ts").alias("action_day"))
