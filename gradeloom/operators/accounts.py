"""User rows, shares and erasure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.privacy import valid_share_token
from gradeloom.functions.text import trim_all
from gradeloom.plans.scale import keep_top


def upsert_users(logins: DataFrame) -> DataFrame:
    """Fold logins ``id, seq, ts, email, nickname``: last non-empty e-mail, last nickname."""
    known = F.when(F.nullif("email", F.lit("")).isNotNull(), F.col("seq"))
    return logins.groupBy("id").agg(
        F.max_by("email", known).alias("email"),
        F.max_by("nickname", "seq").alias("nickname"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("last_seen_at"))


def patch_details(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace columns that a patch sets (non-null), keep the others."""
    p = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    kept = [c for c in rows.columns if c != key and c not in columns]
    return rows.join(p, key, "left").select(
        key, *[F.coalesce(f"_p_{c}", c).alias(c) for c in columns], *kept)


def rename(name: Column, old: Column) -> Column:
    """Trimmed new name; a blank one is refused."""
    trimmed = trim_all(name)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", old).otherwise(trimmed)


def replace_content(rows: DataFrame, incoming: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Replace the content of existing rows; key and ``keep`` columns stay."""
    fresh = incoming.drop(*keep).withColumn("_new", F.lit(True))
    content = [c for c in rows.columns if c != key and c not in keep]
    renamed = fresh.select(key, "_new", *[F.col(c).alias(f"_n_{c}") for c in content])
    return rows.join(renamed, key, "left").select(
        key, *keep, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in content])


def live_shares(shares: DataFrame, as_of: Column) -> DataFrame:
    """Shares with a well-formed token that have not expired; also the purge before an insert."""
    return shares.where(valid_share_token(F.col("token")) & (F.col("expires_at") > as_of))


def owner_delete(comments: DataFrame, requests: DataFrame) -> DataFrame:
    """Remaining comments; a request deletes only the requester's own comment."""
    return comments.join(requests.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def _marked(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables with ``_gone``: true for the rows that deleting the users takes with it; each table is read once."""
    ids = gone.select("user_id").distinct().withColumn("_user", F.lit(True))
    out = {}
    for name, rows in tables.items():
        if name in ("ai_usage", "moderation_actions"):
            out[name] = rows.withColumn("_gone", F.lit(False))
        elif name == "users":
            out[name] = rows.join(ids.withColumnRenamed("user_id", "id"), "id", "left").withColumn("_gone", F.col("_user").isNotNull()).drop("_user")
        else:
            marked = rows.join(ids, "user_id", "left")
            dead = F.lit(False)
            if name in ("comment_likes", "comment_reports") and "comments" in tables:
                own = tables["comments"].join(ids, "user_id", "left_semi").select(F.col("id").alias("comment_id"), F.lit(True).alias("_comment")).distinct()
                marked = marked.join(own, "comment_id", "left")
                dead = F.col("_comment").isNotNull()
            out[name] = marked.withColumn("_gone", F.col("_user").isNotNull() | dead).drop("_user", "_comment")
    return out


def erase_users(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting users: their rows, and likes and reports on their comments.

    ``users`` is keyed by ``id``; usage counters and the moderation log have no user
    reference and are returned unchanged.
    """
    return {name: rows.where(~F.col("_gone")).select(tables[name].columns) for name, rows in _marked(tables, gone).items()}


def erased_counts(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """Rows per table that deleting the users removes."""
    return reduce(DataFrame.unionByName, [
        rows.agg(F.count_if("_gone").alias("erased")).select(F.lit(name).alias("table_name"), "erased") for name, rows in _marked(tables, gone).items()])
