"""Streams of events: idle sessions, housekeeping."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.bucket_table import BucketTable
from memloom.operators.store import purge


def idle_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", pause_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """Sessions that a pause of more than so many whole seconds ends; on a stream, emitted once the watermark passes."""
    when = events.withColumn(ts, F.date_trunc("second", F.col(ts).cast("timestamp"))).withWatermark(ts, late)
    out = when.groupBy(user, F.session_window(ts, f"{pause_seconds} seconds").alias("w")).agg(F.count("*").alias("n_events"))
    return out.select(user, F.col("w.start").alias("session_start"), (F.col("w.end") - F.make_interval(secs=F.lit(pause_seconds))).alias("session_end"), "n_events")


def housekeep(tick: DataFrame, memories: BucketTable, checkpoint: str, hours: float, now: Callable[[], datetime] | None = None, every: str | None = None):
    """A running query that purges old conversation rows of a stored table each time tick, a stream of any rows, has something new: once, or again and again."""

    def purge_once(batch: DataFrame, epoch: int) -> None:
        if (stored := memories.read()) is not None:
            kept = purge(stored, hours, now() if now else None)
            memories.delete(stored.select(*memories.keys).join(kept.select(*memories.keys), list(memories.keys), "left_anti"), f"{checkpoint}#{epoch}")

    query = tick.writeStream.foreachBatch(purge_once).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()
