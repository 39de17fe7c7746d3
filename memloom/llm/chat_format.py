"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation once for each turn it had so far. A running hash over the turns of a conversation, of which
every prefix has one, tells which conversations are prefixes of longer ones: those whose last hash is a hash that a longer
conversation passes through. Conversations that are alike become one class first, that of the smallest conv_id, so both
sides of the anti-join have each hash once, however common a conversation or a first turn is. What remains is rendered.

A turn's hash is two 64-bit hashes of its place, role and text; a prefix's is the exclusive or of its turns', with their number.

Defined results: turns go by turn, then role and text, nulls first; rows repeated whole count once; null roles render as
"user", null texts as empty, unless all of a conversation's are; a null conv_id is a conversation of its own; an empty
table gives no rows; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import cut

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _hashes() -> list[Column]:
    parts = [F.col("place"), F.coalesce("role", F.lit("\u0000")), F.coalesce("text", F.lit("\u0000"))]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("memloom"), *parts[::-1])]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n (turns of the conversation) and the two running hashes, for each turn."""
    each = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text").distinct().withColumn("place", F.row_number().over(each))
    a, b = _hashes()
    hashed = placed.select("conv_id", "place", a.alias("a"), b.alias("b"))
    by_place = Window.partitionBy("conv_id").orderBy("place")
    whole = Window.partitionBy("conv_id")
    return hashed.select("conv_id", "place", F.count("*").over(whole).alias("n"), F.bit_xor("a").over(by_place).alias("h1"), F.bit_xor("b").over(by_place).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies (conversations with the same turns) of each class that is no prefix of a longer one."""
    runs = cut(prefixes(turns))
    last = runs.where("place = n").groupBy("h1", "h2", "place").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    passed = runs.where("place < n").select("h1", "h2", "place").distinct()
    return last.join(passed, ["h1", "h2", "place"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and rendered of the maximal conversations."""
    kept = maximal(turns)
    distinct = turns.select("conv_id", "turn", "role", "text").distinct()
    line = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    kept = kept.withColumnRenamed("conv_id", "_id")
    own = distinct.join(kept, distinct["conv_id"].eqNullSafe(kept["_id"]))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    return own.groupBy("conv_id", "n_turns", "copies").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("rendered"))
