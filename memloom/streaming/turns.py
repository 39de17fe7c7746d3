"""Turns that are first stored as they stand and then replaced by their final form, as a join of two streams.

A partial row waits for its final one; both sides have watermarks, so state is bounded. What the watermark passes without a
partner comes out late: a partial as it stands, for the caller to treat as final; a final one that had no partial, or came
after `wait`, as a row of its own. On tables the same function is the batch twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(partials: DataFrame, finals: DataFrame, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """turn_id, ts, text, state of partials and finals (turn_id, ts, text).

    state: "final" where both were there in time (ts and text are the final ones), "partial" where no final one came within
    `wait` of the partial, "fresh" for a final one without a partial. The embedding is left to a backfill, as text changes.
    """
    p = partials.select(F.col("turn_id").alias("p_id"), F.col("ts").cast("timestamp").alias("p_ts"), F.col("text").alias("p_text")).withWatermark("p_ts", late)
    f = finals.select(F.col("turn_id").alias("f_id"), F.col("ts").cast("timestamp").alias("f_ts"), F.col("text").alias("f_text")).withWatermark("f_ts", late)
    soon = (F.col("p_id") == F.col("f_id")) & (F.col("f_ts") >= F.col("p_ts")) & (F.col("f_ts") <= F.col("p_ts") + F.expr(f"INTERVAL {wait}"))
    state = F.when(F.col("f_id").isNull(), "partial").when(F.col("p_id").isNull(), "fresh").otherwise("final")
    return p.join(f, soon, "full_outer").select(F.coalesce("f_id", "p_id").alias("turn_id"), F.coalesce("f_ts", "p_ts").alias("ts"), F.when(F.col("f_id").isNull(), F.col("p_text")).otherwise(F.col("f_text")).alias("text"), state.alias("state"))
