"""Users of a memory store: made, given new tokens and passwords, and deleted, as changes to a bucket table keyed by username.

Each function takes the stored users and a table of what is asked, and returns rows for BucketTable.upsert (or ids for delete), so
any number of users changes in one job. Tokens are random and never stored: rows hold their SHA-256; the caller gets the tokens
beside them, from one evaluation, and hands them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.embedding import password_hash
from memloom.functions.text import iso_utc, new_token, token_hash
from memloom.operators.lineage import cut

USER = "username string, token_hash string, created string, modified string, token_rotated_at string, preferred_model string, password_hash string"


def _now(now: Column | None) -> Column:
    return iso_utc(now if now is not None else F.current_timestamp())


def created(asked: DataFrame, users: DataFrame | None, now: Column | None = None) -> DataFrame:
    """New rows, with `token`, for usernames (username) that aren't there yet; names that repeat count once."""
    names = asked.select("username").where("username IS NOT NULL").distinct()
    names = names if users is None else names.join(users, "username", "left_anti")
    made = cut(names.withColumn("token", new_token()))  # drawn once
    stamp, none = _now(now), F.lit(None).cast("string")
    return made.select("username", token_hash(F.col("token")).alias("token_hash"), stamp.alias("created"), stamp.alias("modified"), stamp.alias("token_rotated_at"), none.alias("preferred_model"), none.alias("password_hash"), "token")


def rotated(users: DataFrame, older_than: str, now: Column | None = None) -> DataFrame:
    """Rows, with their new `token`, of the users whose token was last changed before a time (ISO-8601) or never."""
    due = users.where(F.coalesce("token_rotated_at", F.lit("")) < older_than)
    made = cut(due.withColumn("token", new_token()))
    return made.withColumns({"token_hash": token_hash(F.col("token")), "token_rotated_at": _now(now), "modified": _now(now)})


def with_passwords(users: DataFrame, asked: DataFrame, iterations: int = 600_000, now: Column | None = None) -> DataFrame:
    """Rows of users with the passwords asked for (username, password), each with a salt of its own."""
    salted = cut(asked.where("password IS NOT NULL").groupBy("username").agg(F.max("password").alias("_p")).withColumn("_s", F.substring(F.sha2(F.uuid(), 256), 1, 32)))
    rows = users.join(salted, "username")
    return rows.withColumns({"password_hash": password_hash(F.col("_p"), F.col("_s"), iterations), "modified": _now(now)}).drop("_p", "_s")


def with_models(users: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of users with the models they prefer (username, model); null takes the preference back."""
    rows = users.join(asked.groupBy("username").agg(F.max_by("model", F.coalesce("model", F.lit(""))).alias("_m")), "username")
    return rows.withColumns({"preferred_model": F.col("_m"), "modified": _now(now)}).drop("_m")
