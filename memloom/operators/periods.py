"""Interval joins: what was valid when something happened, such as a user's token at the time of a request.

Periods are cut at the borders of time bins, so that requests and periods meet by key and bin: a key of a third of all rows is
spread over its bins, and a request meets only the few periods of its bin. A bin should be about as long as a usual period;
periods that cover many bins have a row for each that holds a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def periods(rotations: DataFrame, key: str = "user_id", since: str = "rotated_at", last_for: Column | None = None) -> DataFrame:
    """rotations with `until`: when the next of the key begins, or after `last_for`, whichever is first; null without either.

    Of rotations at the same time the one with the largest row counts, as a struct of its columns.
    """
    row = F.struct(*[c for c in rotations.columns if c not in (key, since)])
    once = rotations.groupBy(key, since).agg(F.max(row).alias("_r")).select(key, since, "_r.*")
    following = F.lead(since).over(Window.partitionBy(key).orderBy(since))
    return once.withColumn("until", F.least(following, F.col(since) + last_for) if last_for is not None else following)


def valid_at(requests: DataFrame, held: DataFrame, key: str = "user_id", at: str = "ts", since: str = "rotated_at", until: str = "until", bin_seconds: int = 86_400) -> DataFrame:
    """requests with the columns of the period of held that holds them (since <= at < until), nulls where none does.

    Periods of a key don't overlap; an end that is null is never. A request without a key or time has no period.
    """
    number = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (bin_seconds * 1_000_000))
    asked = requests.withColumn("_bin", number(F.col(at)))
    # bins that hold requests of the key: a period without an end has no more rows than there are of these
    bins = asked.where(F.col(key).isNotNull() & F.col("_bin").isNotNull()).groupBy(key).agg(F.min("_bin").alias("_low"), F.max("_bin").alias("_high"))
    begin, end = number(F.col(since)), F.coalesce(number(F.col(until)), F.col("_high"))
    inside = held.join(bins, key).where((begin <= F.col("_high")) & (end >= F.col("_low")))
    each = inside.withColumn("_bin", F.explode(F.sequence(F.greatest(begin, "_low"), F.least(end, F.col("_high"))))).drop("_low", "_high")
    more = [c for c in held.columns if c != key]
    each = each.select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), *more)
    match = (asked[key] == each["_k"]) & (asked["_bin"] == each["_b"]) & (each[since] <= asked[at]) & (each[until].isNull() | (asked[at] < each[until]))
    return asked.join(each, match, "left").drop("_bin", "_k", "_b")
