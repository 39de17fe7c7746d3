"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels are learned from rows of the other remainders only.
HELD_OUT_REMAINDER, FOLDS = 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves the held-out remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_REMAINDER, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], most_bytes: int) -> DataFrame:
    """doc_id, y, o, text: labelled documents that aren't held out, for a model to learn from, in rows and bytes bounded.

    Of each label (0 or 1) at most most[label] rows, first by a hash of the id, then by id and a hash of the text, as long as
    they have most_bytes bytes together at most; a row without a label, an id or a text is none of them. Rows that repeat an id
    and a text count once, and of an id's labels the largest counts.
    """
    order, mark = F.xxhash64(F.col("doc_id").cast("string")), F.xxhash64("text")
    told = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = docs.select(own(docs, "doc_id").alias("doc_id"), own(docs, "text").alias("text")).where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    keys = known.select("doc_id", mark.alias("t"), F.octet_length("text").alias("bytes")).distinct().join(told, "doc_id").withColumn("o", order)
    picked = None
    for y, n in most.items():
        some = keys.where(F.col("y") == y).orderBy("o", "doc_id", "t").limit(n)
        some = some.withColumn("upto", F.sum("bytes").over(Window.partitionBy("y").orderBy("o", "doc_id", "t")))  # n rows at most
        some = some.where(F.col("upto") <= most_bytes // len(most)).drop("upto", "bytes")
        picked = some if picked is None else picked.unionByName(some)
    return known.withColumn("t", mark).join(F.broadcast(picked), ["doc_id", "t"]).groupBy("doc_id", "y", "o", "t").agg(F.min("text").alias("text")).drop("t")


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any case, which an operator is about to add."""
    gone = {n.lower() for n in names}
    return df.select(*[own(df, c) for c in df.columns if c.lower() not in gone])


def own(df: DataFrame, name: str) -> Column:
    """df's column of this very name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def packed(df: DataFrame, *without: str, name: str = "_row") -> Column:
    """One struct of df's columns but those, for operators that add columns of their own beside it; select("_row.*") unpacks it."""
    gone = {n.lower() for n in without}
    return F.struct(*[own(df, c) for c in df.columns if c.lower() not in gone]).alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not (where := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/memloom-{os.getpid()}"
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut, from files in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that scratch() named, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(texts: Iterable[str | None], most: int = 1 << 20, gap: bytes = b"\n\n\n") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' UTF-8 bytes, whole texts side by side until they exceed `most` bytes: bytes, starts, ends.

    `gap` precedes the first text and follows each; a null text is empty. Lone surrogates, which UTF-8 lacks, are replaced.
    """
    parts: list[bytes] = []
    held = 0
    for t in texts:
        parts.append((t or "").encode("utf-8", "replace"))
        held += len(parts[-1])
        if held >= most:
            yield _joined(parts, gap)
            parts, held = [], 0
    if parts:
        yield _joined(parts, gap)


def _joined(parts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = len(gap) + np.cumsum(lens + len(gap)) - (lens + len(gap))
    return np.frombuffer(gap + gap.join(parts) + gap, np.uint8), starts, starts + lens


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values[start:end] of each range."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]
