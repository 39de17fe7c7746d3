"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item's windows are its runs of `window` words, or all its words where it has fewer. A document contains a
window only if it contains every word of it, so for this threshold (all of a window) a prefix of one word is enough: the
window's rarest by document counts over the whole corpus. Document words join those prefix words; a candidate's place is
bound by where the prefix word stands in the window and by the document's length, and what remains is compared word for
word. The window table goes to every executor only while the benchmark's own size, which is summed first, is small; beyond
that it is an ordinary shuffled join, which adaptive execution splits where a word is common. That join carries with each
word the words that a window around it can reach, never a whole text.

Defined results: a null text has no words (0 words, 0 hits, not contaminated); repeated rows get a row each; items without
words have no windows; a null item_id hits but is not counted or listed; empty tables give no rows or no hits; input columns
named as outputs are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut, own, packed

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, and words in any case: the same sets, written so that Java matches them several times faster.
BETWEEN, ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: Bytes of benchmark text up to which its windows are broadcast; they take at most about `window` + 1 times as much.
BROADCAST_TEXT = 2 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (id as string), id (a hash of the words) and gram (array of words) of each window of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("gram"))
    return grams.select("item", F.sha2(F.array_join("gram", " "), 256).alias("id"), "gram").distinct()


def hits(docs: DataFrame, grams: DataFrame, small: bool, window: int = WINDOW) -> DataFrame:
    """doc_id, mark (a hash of the text), n_words, at (0-based), n (words), id: the windows that occur in each document."""
    sent = F.broadcast if small else lambda df: df
    unique = grams.groupBy("id").agg(F.first("gram").alias("gram"))
    vocabulary = unique.select(F.explode("gram").alias("word")).distinct()
    said = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    # the outer forms spare a filter on the number of words, for which texts would be cut into words twice
    counts = said.select(F.explode_outer("w").alias("word")).join(sent(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = unique.select("id", F.posexplode("gram").alias("place", "word")).join(counts, "word")  # a word that no document has rules its window out
    prefix = ranked.groupBy("id").agg(F.min(F.struct("n", "word", "place")).alias("p"), F.count("*").alias("there"))
    lists = unique.join(prefix, "id").where(F.col("there") == F.size("gram")).select("id", F.col("p.word").alias("word"), F.col("p.place").alias("place"), "gram")
    spots = said.select("doc_id", "mark", F.size("w").alias("n_words"), F.lit(0).alias("begin"), "w", F.posexplode_outer("w").alias("pos", "word"))
    if not small:
        begin = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        spots = spots.select("doc_id", "mark", "n_words", begin.alias("begin"), F.slice("w", begin + 1, F.lit(2 * window - 1)).alias("w"), "pos", "word")
    found = spots.join(sent(lists), "word")
    at = F.col("pos") - F.col("place")
    inside = (at >= 0) & (at - F.col("begin") + F.size("gram") <= F.size("w"))
    same = F.slice("w", at - F.col("begin") + 1, F.size("gram")) == F.col("gram")
    return found.where(inside).where(same).select("doc_id", "mark", "n_words", at.alias("at"), F.size("gram").alias("n"), "id")


def covered(spans: Column) -> Column:
    """How many places the sorted spans (at, n) cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["n"])
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], x["at"])).alias("total"))

    return F.aggregate(spans, start, add, lambda acc: acc["total"])


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """_doc, _mark (a hash of the text), _words, _hit, _items: a row for each document with a hit. Windows are joined with the items that hold them once a document."""
    small = (benchmark.agg(F.sum(F.octet_length("text"))).head()[0] or 0) <= BROADCAST_TEXT
    grams = windows(benchmark, window)
    hit = cut(hits(docs, grams, small, window).groupBy("doc_id", "mark").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.collect_set("id").alias("ids")))
    owners = grams.select("id", "item")
    named = hit.select("doc_id", "mark", F.explode("ids").alias("id")).join(F.broadcast(owners) if small else owners, "id")
    named = named.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.array_sort(F.collect_set("item")).alias("_items"))
    out = hit.select("doc_id", "mark", F.col("n_words").cast("long").alias("_words"), covered(F.col("spans")).cast("long").alias("_hit"))
    return out.join(named, out["doc_id"].eqNullSafe(named["_doc"]) & (out["mark"] == named["_mark"])).select("_doc", "_mark", "_words", "_hit", "_items")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_hit: int = 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (any hit, and per_hit * n_hit >= n_words)."""
    by = found(docs, benchmark, window)
    n_words = F.coalesce(F.regexp_count(own(docs, "text"), F.lit(ANY_CASE)), F.lit(0)).cast("long")
    base = docs.select(packed(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), own(docs, "doc_id").alias("_id"), F.xxhash64(own(docs, "text")).alias("_key"), n_words.alias("n_words"))
    out = base.join(by, base["_id"].eqNullSafe(by["_doc"]) & (base["_key"] == by["_mark"]), "left")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    return out.select(
        "_row.*", "n_words", n_hit.alias("n_hit"), F.greatest(F.coalesce(F.size("_items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (per_hit * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_hit: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with their own columns only."""
    bad = found(docs, benchmark, window).where((F.col("_hit") > 0) & (per_hit * F.col("_hit") >= F.col("_words"))).select("_doc", "_mark")
    return docs.join(bad, own(docs, "doc_id").eqNullSafe(bad["_doc"]) & (F.xxhash64(own(docs, "text")) == bad["_mark"]), "left_anti")
