"""Query logs: lines of searches, and sketches of their latencies that can be merged.

A sketch is a table: for each group the number of values in each bucket of a logarithmic scale, whose buckets are `accuracy`
wide on either side. Sketches of hours, of files or of machines are merged by adding numbers, so a day's quantile comes from
its hours without reading a line again; a quantile is off by at most `accuracy` of its value. Buckets are few whatever the
number of lines (some 1,000 from a microsecond to a day at 1 %), and counting combines before it shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import iso_utc


def query_line(at: Column, query: Column, results: Column, ms: Column) -> Column:
    """One line of the query log. Line breaks in a query become spaces, so that a search is one line."""
    said = F.regexp_replace(query, r"[\r\n]+", " ")
    return F.concat(iso_utc(at), F.lit(' [INFO] query="'), said, F.lit('" results='), results.cast("string"), F.lit(" time="), ms.cast("string"), F.lit("ms"))


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with at, level, query, results and ms; lines that aren't of a search have none of the last three and are left out.

    A query may hold quotes and what looks like another field: fields are read from the line's end.
    """
    form = r'^(\S+(?: \d\S*)?) \[(\w+)\] query="(.*)" results=(\d+) time=(\d+(?:\.\d+)?)ms\s*$'
    of = lambda i: F.regexp_extract(F.col(line), form, i)
    out = lines.where(F.col(line).rlike(form))
    return out.withColumns({"at": F.coalesce(F.try_to_timestamp(of(1)), F.try_to_timestamp(of(1), F.lit("yyyy-MM-dd HH:mm:ss"))), "level": of(2), "query": of(3), "results": of(4).cast("long"), "ms": of(5).cast("double")})


def _scale(accuracy: float) -> float:
    return math.log((1 + accuracy) / (1 - accuracy))


def sketch(values: DataFrame, value: str, *by: str, accuracy: float = 0.01) -> DataFrame:
    """by, bucket, n: the sketch of each group. Values of 0 or less are in a bucket of their own (null), nulls in none."""
    v = F.col(value)
    return values.where(v.isNotNull()).groupBy(*by, F.when(v > 0, F.ceil(F.round(F.log(v) / _scale(accuracy), 9))).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches added up for coarser groups."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, *by: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: float = 0.01) -> DataFrame:
    """by, n, and q50, q95, ... of each group: within `accuracy` of the smallest value that so great a share doesn't exceed."""
    upto = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # buckets of a group, not values
    size = sketches.groupBy(*by).agg(F.sum("n").alias("_all"))
    placed = sketches.withColumn("_upto", F.sum("n").over(upto)).join(size, list(by)) if by else sketches.withColumn("_upto", F.sum("n").over(upto)).crossJoin(F.broadcast(size))
    middle = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.exp(F.col("bucket") * _scale(accuracy)) * (1 - accuracy))
    order = F.coalesce("bucket", F.lit(-(1 << 60)))
    found = [F.min_by(F.when(F.col("_upto") >= F.ceil(F.lit(s) * F.col("_all")), middle), F.when(F.col("_upto") >= F.ceil(F.lit(s) * F.col("_all")), order)).alias(f"q{round(100 * s)}") for s in shares]
    return placed.groupBy(*by).agg(F.first("_all").alias("n"), *found)
