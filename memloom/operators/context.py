"""What goes before a model: budgeted prefixes of files, summaries, retention by count."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = "\n\n---\n\n"


def truncated(text: Column, budget: Column, label: Column) -> Column:
    """The whole paragraphs that fit a budget of bytes, two more counted for each, and a note; empty if none does."""
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

    def add(acc: Column, p: Column) -> Column:
        full = acc["full"] | (F.octet_length(acc["kept"]) + F.octet_length(p) + 2 > budget)
        more = F.when(acc["kept"] == "", p).otherwise(F.concat(acc["kept"], F.lit("\n\n"), p))
        return F.struct(F.when(full, acc["kept"]).otherwise(more).alias("kept"), full.alias("full"))

    note = F.concat(F.lit("\n\n[... "), label, F.lit(" truncated ...]"))
    return F.aggregate(F.filter(F.split(text, "\n\n+"), lambda p: p != ""), start, add, lambda acc: F.when(acc["kept"] == "", "").otherwise(F.concat(acc["kept"], note)))


def within_budget(files: DataFrame, budget: int, group: str = "session", order: str = "ord") -> DataFrame:
    """group, order, section: files in order while they fit, separators of 8 bytes counted; the first that doesn't is cut at a paragraph and ends it."""
    w = Window.partitionBy(group).orderBy(order)
    said = files.withColumn("_t", F.regexp_replace("text", r"[ \t\r\n]+\z", "")).where("_t <> ''").withColumn("_n", F.octet_length("_t"))
    run = said.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 8 * (F.row_number().over(w) - 1))
    fits = F.col("_n") <= F.lit(budget) - F.col("_before")
    first = run.withColumn("_bad", F.sum((~fits).cast("int")).over(w)).where((F.col("_bad") == 0) | ((F.col("_bad") == 1) & ~fits))
    cut = truncated(F.col("_t"), F.lit(budget) - F.col("_before"), F.col("label"))
    return first.withColumn("section", F.when(fits, F.col("_t")).otherwise(cut)).where("section <> ''").select(group, order, "section")


def extractive(text: str | None, sentences: int = 3) -> str:
    """The first sentence of each of the first paragraphs."""
    parts = [p.strip() for p in (text or "").split("\n\n") if p.strip()]
    return " ".join(p.split(". ")[0].rstrip(".") + "." for p in parts[:sentences])


def summarizer(load: Callable[[], Callable[[list[str]], list[str]]] | None = None):
    """A column function from a rendered conversation to its summary; load gives a model once for each batch of rows."""

    @F.pandas_udf(T.StringType())
    def summarize(texts: pd.Series) -> pd.Series:
        model = load() if load else lambda some: [extractive(t) for t in some]
        return pd.Series(model(list(texts)))

    return summarize


def newest(memories: DataFrame, most: int, by: str = "collection") -> DataFrame:
    """Retention by count: the newest rows of each collection."""
    w = Window.partitionBy(by).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return memories.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
