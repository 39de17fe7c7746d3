"""Conversation logs taken in as they come: new files only, none twice, and turns paired across files.

A file stream remembers in its checkpoint which files it has read. Each micro-batch puts its turns into a stored table, keyed by
file and line, and pairs anew the sessions that it touches, so an answer in a later file completes a question in an earlier one.
Both tables take a batch once, also where it is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.bucket_table import BucketTable
from memloom.operators.conversation import pair_turns
from memloom.sources.files import log_turns


def stored_turns(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, f"{path}/turns", ("session_id", "file", "seq"), "batch", buckets)


def stored_pairs(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """session_id, file, seq, timestamp of the user's turn, user_text, assistant_text."""
    return BucketTable(spark, f"{path}/pairs", ("session_id", "file", "seq"), "batch", buckets)


def paired(turns: DataFrame) -> DataFrame:
    """Pairs of sessions' turns in order of time, then file, then line."""
    placed = turns.withColumn("place", F.struct("timestamp", "file", "seq"))
    return pair_turns(placed, "session_id", "place").select("session_id", "place.file", "place.seq", "place.timestamp", "user_text", "assistant_text")


def ingest(spark: SparkSession, path: str, to: str, checkpoint: str, clean: str | None = None, archive: str | None = None, buckets: int = 64):
    """A running query that takes in what is new among the JSONL files of a folder, and ends.

    clean: "delete" or "archive" (to the folder `archive`) what has been taken in.
    """
    raw = spark.readStream.schema("value string")
    for key, value in (("cleanSource", clean), ("sourceArchiveDir", archive)):
        raw = raw.option(key, value) if value else raw
    files = raw.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    turns, pairs = stored_turns(spark, to, buckets), stored_pairs(spark, to, buckets)

    def take(batch: DataFrame, epoch: int) -> None:
        name = f"{checkpoint}#{epoch}"
        new = log_turns(batch).withColumn("batch", F.lit(epoch))
        turns.upsert(new, name)
        if (kept := turns.read()) is not None:
            touched = new.select("session_id").distinct()
            pairs.upsert(paired(kept.join(touched, "session_id", "left_semi")).withColumn("batch", F.lit(epoch)), name)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
