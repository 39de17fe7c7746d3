"""Changes to the memory table and its children, each as the next snapshot: a DataFrame to write.

There is no table format with row updates here, so a change is a function from a table to the table after it.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import iso_utc, short_home
from memloom.operators.lineage import cut
from memloom.operators.metadata import protected, split_metadata


def new_rows(batch: DataFrame, first_id: int, home: str = "", now: Column | None = None) -> DataFrame:
    """batch (text, metadata) as rows to append: fields lifted, paths shortened, ids from first_id on.

    Ids follow the order of text within partitions that a running count places, so no single task numbers the batch.
    """
    rows = split_metadata(batch.select(short_home(F.col("text"), home).alias("text"), "metadata"))
    stamp = F.coalesce("meta_timestamp", iso_utc(now if now is not None else F.current_timestamp()))
    out = rows.withColumn("timestamp", stamp).drop("meta_timestamp")
    return numbered(out, first_id, "text").withColumn("embedding", F.lit(None).cast("array<float>"))


def numbered(df: DataFrame, first_id: int, *order: str) -> DataFrame:
    """df with id from first_id on, without gaps, in the order of the columns.

    The ordered rows are written once, as a checkpoint: partitions are then the same for the rows and for their counts,
    whatever is planned anew. Rows that are alike are dealt out as well, so none of them meet in one task.
    """
    dealt = df.withColumn("_row", F.monotonically_increasing_id())
    parts = cut(dealt.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row"))
    parts = parts.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()})
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    before = sizes.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    return parts.join(F.broadcast(before), "_p").withColumn("id", F.col("_before") + F.col("_k") - F.col("_first") + first_id).drop("_p", "_k", "_first", "_before")


def delete(memories: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, deleted) for a table of ids; protected rows stay, unknown ids do nothing."""
    doomed = memories.where(~protected(F.col("tags"))).join(ids.select("id").distinct(), "id", "left_semi")
    return memories.join(doomed.select("id"), "id", "left_anti"), doomed


def cascade(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """Postings or usage without the rows of deleted memories."""
    return children.join(deleted.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_anti")


def purge(memories: DataFrame, hours: float, now: datetime | None = None, compat: bool = False) -> DataFrame:
    """Without conversation rows older than so many hours. compat purges protected ones too."""
    now = now or datetime.now(timezone.utc)
    cutoff = (now - timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%SZ")
    old = (F.col("collection") == "conversation") & (F.col("timestamp") < cutoff)
    return memories.where(~(old if compat else old & ~protected(F.col("tags"))))


def update_text(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, text, metadata) applied where the row exists and isn't protected: the id and time stay, the embedding goes, unnamed fields are reset."""
    changed = split_metadata(changes).drop("meta_timestamp")
    fresh = memories.where(~protected(F.col("tags"))).select("id", "timestamp").join(changed, "id").withColumn("embedding", F.lit(None).cast("array<float>"))
    return memories.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest(versions: DataFrame, *keys: str, order: str) -> DataFrame:
    """The last version of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return versions.withColumn("_v", F.row_number().over(newest)).where("_v = 1").drop("_v")


def upsert(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Rows of changes instead of those of table with their keys."""
    return table.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def usage(hits: DataFrame, now: Column | None = None) -> DataFrame:
    """A row to append for each hit, all of one time."""
    return hits.select(F.col("id").alias("memory_id"), iso_utc(now if now is not None else F.current_timestamp()).alias("timestamp"))


def backfill(memories: DataFrame, embed) -> DataFrame:
    """embed applied where there is no embedding."""
    missing = memories.where(F.col("embedding").isNull()).withColumn("embedding", embed(F.col("text")))
    return memories.where(F.col("embedding").isNotNull()).unionByName(missing)


def rebuild_embeddings(memories: DataFrame, embed) -> DataFrame:
    return memories.withColumn("embedding", embed(F.col("text")))


def signed_in(users: DataFrame, sessions: DataFrame, now: str) -> DataFrame:
    """Users with a web session that hasn't expired."""
    live = sessions.where(F.col("expires") > now)
    return users.join(live.select("token", "user_id", "expires"), users["id"] == live["user_id"]).drop("user_id")
