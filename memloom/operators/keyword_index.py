"""A keyword index that is stored: bucketed postings with adds, deletes and merges, and top-k search that skips blocks.

Postings are a table bucketed by token, so a search joins its few terms to them without moving a posting. A common token is
split in parts, each of which is a bucket key of its own. Tallies are a table bucketed by memory, with each memory's tokens: a
change counts a text once and takes from there what postings it adds or hides, so none has to be looked for among all.
Adding memories writes their tallies and postings beside the others, deleting some writes their ids; rows carry the number of
the change that wrote them, and a deleted id hides rows of smaller numbers.
A merge writes a generation without what is hidden: its tallies, and its postings as blocks, made from tallies that move once,
by shard. A block is what a token has in one shard, about `shard` memories of about the same length, with the greatest
frequency and the least length in it, which bound every score there whatever the average length becomes. A search for the best
k first sums the bounds for each query and shard, scores the most promising shards to get a threshold, and then reads only
blocks of shards whose bound reaches it. Its results are those of bm25() over all postings, ties included.
A generation has as many buckets as its memories call for, `buckets` at least.

Memories: id, text. A null text has no postings; adding an id that is there replaces it; ids that aren't there are deleted
without effect. Ids within one batch are distinct.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators import tallies
from memloom.operators.ledger import Ledger
from memloom.operators.lineage import cut, kept
from memloom.operators.retrieval import Blend, idf, top

#: Postings of a token above which it is split in parts; memories of a shard; shards of a query that give its threshold; ids, terms and shards that are broadcast.
HOT, SHARD, PROBED, MOST_SENT = 1_000_000, 64, 4, 200_000
#: Memories of a bucket; shards that are dealt out together when blocks are made.
FULL, TOGETHER = 16_384, 64

_POSTINGS = "token string, part int, memory_id bigint, term_freq int, dl bigint, epoch bigint"
_TALLIES = f"{tallies.TALLY}, epoch bigint"
_GONE = "memory_id bigint, epoch bigint, hid bigint, dl bigint"
_LOST = "token string, n bigint, epoch bigint"
_BLOCKS = tallies.GROUPED.replace("token string,", "token string, part int,")
#: Table: its columns, and what it is bucketed by.
_TABLES = {"postings": (_POSTINGS, ("token", "part")), "tallies": (_TALLIES, ("memory_id",)), "gone": (_GONE, ("memory_id",)), "lost": (_LOST, ("token",)), "blocks": (_BLOCKS, ("token", "part")), "hot": ("token string, parts int", ("token",))}


@dataclass(frozen=True)
class Stats:
    """What the ledger says: the generation, its changes, the number of live memories with a posting and their total length, deleted ids."""

    generation: int
    epochs: tuple[int, ...]
    merged: int
    docs: int
    length: int
    gone: int
    buckets: int


@dataclass(frozen=True)
class KeywordIndex:
    spark: SparkSession
    path: str
    buckets: int = 16
    hot: int = HOT
    shard: int = SHARD

    # -- tables

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.path}/ledger")

    def stats(self) -> Stats:
        done = self.ledger.committed()
        generation = max((x["generation"] for x in done), default=0)
        of = [x for x in done if x["generation"] == generation]
        merged, buckets = max((x["number"] for x in of if x["kind"] == "merge"), default=0), max((x["buckets"] for x in of), default=self.buckets)
        return Stats(generation, tuple(x["number"] for x in of), merged, sum(x["docs"] for x in of), sum(x["length"] for x in of), sum(x["gone"] for x in of), buckets)

    def _enough(self, memories: int) -> int:
        return max(self.buckets, -(-memories // FULL))

    def _name(self, kind: str, generation: int, buckets: int) -> str:
        """The table's name in this session's catalog, to which its folder is added if it is new there."""
        columns, by = _TABLES[kind]
        name = f"memloom_{kind}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{generation}_{buckets}"
        if not self.spark.catalog.tableExists(name):
            keys = ", ".join(by)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{self.path}/g{generation}/{buckets}/{kind}'")
        return name

    def _read(self, kind: str, now: Stats) -> DataFrame:
        name = self._name(kind, now.generation, now.buckets)
        self.spark.catalog.refreshTable(name)
        found = self.spark.table(name)
        return found.where(F.col("epoch").isin(*now.epochs)) if "epoch" in found.columns else found

    def _append(self, kind: str, generation: int, rows: DataFrame, buckets: int | None = None) -> None:
        buckets = buckets or self.stats().buckets
        name = self._name(kind, generation, buckets)
        rows.select(*self.spark.table(name).columns).repartition(buckets, *_TABLES[kind][1]).write.insertInto(name)  # one file a bucket

    def _of(self, kind: str, now: Stats, epoch: int) -> DataFrame:
        """What a change that hasn't ended yet has written."""
        return self.spark.table(self._name(kind, now.generation, now.buckets)).where(F.col("epoch") == epoch)

    def _gone(self, now: Stats) -> DataFrame:
        found = self._read("gone", now).groupBy("memory_id").agg(F.max("epoch").alias("_gone"))
        return F.broadcast(found) if now.gone <= MOST_SENT else found

    def _live(self, rows: DataFrame, now: Stats) -> DataFrame:
        """rows (memory_id, epoch, ...) that no later change hides."""
        if not now.gone:
            return rows
        return rows.join(self._gone(now), "memory_id", "left").where(F.coalesce(F.col("_gone") <= F.col("epoch"), F.lit(True))).drop("_gone")

    def postings(self) -> DataFrame:
        """memory_id, token, term_freq, dl of all that is live."""
        now = self.stats()
        merged = _entries(self._read("blocks", now), "token").withColumn("epoch", F.lit(now.merged).cast("long"))
        return self._live(self._read("postings", now).select(*merged.columns).unionByName(merged), now).select("memory_id", "token", "term_freq", "dl")

    # -- changes

    def _split(self, blocks: DataFrame, by: Column, now: Stats) -> DataFrame:
        """blocks (token, ...) with the part of the token that they belong to, by a number."""
        hot = self._read("hot", now)  # at most a row for so many postings
        return blocks.join(F.broadcast(hot), "token", "left").withColumn("part", F.pmod(by, F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def _hide(self, ids: DataFrame, epoch: int, now: Stats) -> dict:
        """Writes those of ids that are there as deleted, with what their tokens lose; returns what the ledger has to know."""
        held = self._read("tallies", now).select("memory_id", "dl", "epoch")
        there = self._live(held.join(ids.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi"), now)
        self._append("gone", now.generation, there.select("memory_id", F.lit(epoch).cast("long").alias("epoch"), F.col("epoch").alias("hid"), "dl"), now.buckets)
        mine = self._of("gone", now, epoch)
        n, length = mine.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).head()
        if not n:
            return {"docs": 0, "length": 0, "gone": 0}
        # both tables are bucketed by memory, so none of their rows moves; what was live is the last of its memory
        held, hidden = self._read("tallies", now).select("memory_id", "tokens", "epoch"), mine.select("memory_id", "hid")
        lost = held.join(F.broadcast(hidden) if n <= MOST_SENT else hidden, "memory_id").where("epoch >= hid").select(F.explode("tokens").alias("token"))
        self._append("lost", now.generation, lost.groupBy("token").agg(F.count("*").alias("n")).withColumn("epoch", F.lit(epoch).cast("long")), now.buckets)
        return {"docs": -n, "length": -length, "gone": n}

    def add(self, memories: DataFrame) -> int:
        """Adds memories (id, text), or replaces them; returns the change's number."""
        now, epoch = self.stats(), self.ledger.claim()
        if not now.epochs:
            now = replace(now, buckets=self._enough(memories.select("id").count()))
        said = {"docs": 0, "length": 0, "gone": 0} if not now.epochs else self._hide(memories, epoch, now)
        counted = memories.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL").mapInArrow(tallies.tallied, tallies.TALLY)
        number = F.lit(epoch).cast("long")
        self._append("tallies", now.generation, counted.withColumn("epoch", number), now.buckets)
        mine = self._of("tallies", now, epoch)
        # postings move by token as lists, and are rows of their own where they are written; a list goes on under its first memory's part
        lists = mine.select("memory_id", "dl", "tokens", "freqs", F.lit(0).cast("long").alias("shard")).mapInArrow(tallies.grouped_slices, tallies.GROUPED)
        placed = self._split(lists, F.xxhash64(F.col("entries")[0][0]["memory_id"]), now).select("token", "part", "entries")
        placed = _entries(placed.repartition(now.buckets, "token", "part").sortWithinPartitions("token", "part"), "token", "part")
        self._append("postings", now.generation, placed.withColumn("epoch", number), now.buckets)
        docs, length = mine.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).head()
        self.ledger.commit(epoch, kind="add", generation=now.generation, buckets=now.buckets, **said | {"docs": said["docs"] + docs, "length": said["length"] + length})
        return epoch

    def remove(self, ids: DataFrame) -> int:
        """Deletes the memories of these ids (id)."""
        now, epoch = self.stats(), self.ledger.claim()
        self.ledger.commit(epoch, kind="remove", generation=now.generation, buckets=now.buckets, **self._hide(ids, epoch, now))
        return epoch

    def merge(self) -> int:
        """Writes the next generation: what is live, without deleted ids, common tokens in parts, and blocks of postings."""
        now, epoch = self.stats(), self.ledger.claim()
        then = Stats(epoch, (epoch,), epoch, now.docs, now.length, 0, self._enough(now.docs))
        live = self._live(self._read("tallies", now), now)
        self._append("tallies", epoch, live.withColumn("epoch", F.lit(epoch).cast("long")), then.buckets)
        written = self._read("tallies", then)
        if now.docs > self.hot:  # else no token has so many
            counts = written.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > self.hot)
            self._append("hot", epoch, counts.select("token", F.ceil(F.col("n") / self.hot).cast("int").alias("parts")), then.buckets)
        lists = self._sharded(written).repartition(F.floor(F.col("shard") / TOGETHER)).sortWithinPartitions("shard").mapInArrow(tallies.grouped_slices, tallies.GROUPED)
        self._append("blocks", epoch, self._split(lists, F.col("heads")[0]["shard"], then), then.buckets)
        self.ledger.commit(epoch, kind="merge", generation=epoch, buckets=then.buckets, docs=now.docs, length=now.length, gone=0)
        return epoch

    def _sharded(self, rows: DataFrame) -> DataFrame:
        """Tallies with their shard: memories are numbered by length, those of the same length by a hash that leaves gaps and gives some a number twice."""
        sizes = rows.groupBy("dl").agg(F.count("*").alias("_n"))
        before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("dl")) - F.col("_n"))  # a row for each length that a text has
        place = F.col("_before") + F.pmod(F.xxhash64("memory_id"), F.col("_n"))
        return rows.join(F.broadcast(before), "dl").select("memory_id", "dl", "tokens", "freqs", F.floor(place / self.shard).alias("shard"))

    def vacuum(self) -> None:
        """Removes the generations before the current one, and their entries. Not while they are read."""
        now = self.stats()
        for old in {x["generation"] for x in self.ledger.committed()} - {now.generation}:
            for kind in _TABLES:
                for buckets in {x["buckets"] for x in self.ledger.committed() if x["generation"] == old}:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._name(kind, old, buckets)}")
            fs, where = self.ledger._at("..", f"g{old}")
            fs.delete(where, True)
        self.ledger.forget([x["number"] for x in self.ledger.committed() if x["generation"] != now.generation])

    # -- searches

    def _terms(self, terms: DataFrame, now: Stats) -> DataFrame:
        """terms (query_id, token, qtf) with a row for each part of the token."""
        parts = terms.join(self._read("hot", now), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        return parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def hits(self, terms: DataFrame, after: int = 0) -> DataFrame:
        """query_id, token, qtf, memory_id, term_freq, dl: live postings of terms, of changes after that one. Only what matches is moved."""
        now = self.stats()
        cols, asked = ("query_id", "token", "qtf"), self._terms(terms, now)
        held = self._read("postings", now).where(F.col("epoch") > after).join(asked, ["token", "part"]).select(*cols, "memory_id", "term_freq", "dl", "epoch")
        if after < now.merged:
            merged = self._read("blocks", now).join(asked, ["token", "part"])
            held = held.unionByName(_entries(merged, *cols).withColumn("epoch", F.lit(now.merged).cast("long")))
        return self._live(held, now).select(*cols, "memory_id", "term_freq", "dl")

    def bm25(self, terms: DataFrame, how: Blend = Blend()) -> DataFrame:
        """query_id, memory_id, bm25 of all memories that share a term with a query."""
        now, hit = self.stats(), self.hits(terms)
        df = hit.groupBy("query_id", "token").agg(F.count("*").alias("df"))
        part = F.col("qtf") * idf(F.lit(now.docs), F.col("df")) * saturated(F.col("term_freq"), F.col("dl"), now, how)
        return hit.join(df, ["query_id", "token"]).groupBy("query_id", "memory_id").agg(F.sum(part).alias("bm25"))

    def weights(self, terms: DataFrame) -> DataFrame:
        """terms with `weight`: the query's count times the token's idf, from blocks' sizes, what came since, and what was deleted."""
        now = self.stats()
        asked = self._terms(terms.select("token").distinct(), now)
        merged = self._read("blocks", now).join(asked, ["token", "part"]).groupBy("token").agg(F.sum("n").alias("n"))
        since = self._read("postings", now).where(F.col("epoch") > now.merged).join(asked, ["token", "part"]).groupBy("token").agg(F.count("*").alias("n"))
        lost = self._read("lost", now).join(terms.select("token").distinct(), "token", "left_semi").groupBy("token").agg((-F.sum("n")).alias("n"))
        df = reduce(DataFrame.unionByName, (merged, since, lost)).groupBy("token").agg(F.sum("n").alias("df"))
        return terms.join(df, "token").where("df > 0").withColumn("weight", F.col("qtf") * idf(F.lit(now.docs), F.col("df"))).drop("df")

    def bounds(self, weighed: DataFrame, how: Blend = Blend()) -> DataFrame:
        """query_id, shard, blocks, bound: the most that a memory of a shard can score."""
        now = self.stats()
        heads = self._read("blocks", now).select("token", "part", "heads").join(_sent(self._terms(weighed, now), weighed.count()), ["token", "part"]).select("query_id", "weight", F.explode("heads").alias("h")).select("query_id", "weight", "h.*")
        part = F.col("weight") * saturated(F.col("max_tf"), F.col("min_dl"), now, how)
        return heads.groupBy("query_id", "shard").agg(F.count("*").alias("blocks"), F.sum(part).alias("bound"))

    def _scored(self, weighed: DataFrame, shards: DataFrame, how: Blend, now: Stats) -> DataFrame:
        """query_id, memory_id, epoch, bm25 of what the blocks of these shards (query_id, shard) hold, deleted or not."""
        held = self._read("blocks", now).select("token", "part", "heads.shard", "entries").join(_sent(self._terms(weighed, now), weighed.count()), ["token", "part"])
        each = held.select("query_id", "weight", F.explode(F.arrays_zip("shard", "entries")).alias("b")).select("query_id", "weight", "b.*").join(shards, ["query_id", "shard"])
        each = each.select("query_id", "shard", "weight", F.explode("entries").alias("e")).select("query_id", "shard", "weight", "e.*")
        # rows of a query and shard have met already, so summing moves nothing
        return each.groupBy("query_id", "shard", "memory_id").agg(_score(now, how)).select("query_id", "memory_id", F.lit(now.merged).cast("long").alias("epoch"), "bm25")

    def _least(self, weighed: DataFrame, bound: DataFrame, how: Blend, now: Stats) -> DataFrame:
        """query_id, threshold: a score that the best `limit` memories reach; no row where so many weren't found."""
        first = bound.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard"))).where(F.col("_r") <= PROBED)
        first = cut(first.select("query_id", "shard"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
        tried = self._live(self._scored(weighed, _sent(first, first.count()), how, now), now).withColumn("_r", F.row_number().over(order))
        least = cut(tried.where(F.col("_r") == how.limit).select("query_id", F.col("bm25").alias("threshold")))
        return _sent(least, least.count())

    def choice(self, weighed: DataFrame, how: Blend = Blend()) -> DataFrame:
        """bounds() with `threshold`, a score that the best `limit` memories reach, and `read`: whether the shard can hold one of them."""
        bound = kept(self.bounds(weighed, how), "bounds")
        return bound.join(self._least(weighed, bound, how, self.stats()), "query_id", "left").withColumn("read", _reaches("bound"))

    def search(self, terms: DataFrame, how: Blend = Blend()) -> DataFrame:
        """query_id, id, bm25, rank: the best `limit` memories of each query of terms (query_id, token, qtf), ties by id."""
        now, weighed = self.stats(), cut(self.weights(terms))
        bound = kept(self.bounds(weighed, how), "bounds")
        least = self._least(weighed, bound, how, now)
        shards = bound.join(least, "query_id", "left").where(_reaches("bound")).select("query_id", "shard")
        scored = self._scored(weighed, shards, how, now)
        fresh = self._read("postings", now).where(F.col("epoch") > now.merged).join(_sent(self._terms(weighed, now), weighed.count()), ["token", "part"])
        fresh = fresh.groupBy("query_id", "memory_id", "epoch").agg(_score(now, how))
        # only what reaches the threshold is looked up among the deleted ids; a memory is either merged or fresh
        near = scored.unionByName(fresh).join(least, "query_id", "left").where(_reaches("bm25")).drop("threshold")
        found = self._live(near, now).withColumnsRenamed({"memory_id": "id"})
        return top(found.withColumns({"score": F.lit(0.0), "combined": F.col("bm25")}), how).select("query_id", "id", "bm25", "rank")


def _entries(blocks: DataFrame, *cols: str) -> DataFrame:
    """Of blocks these columns and memory_id, term_freq, dl: a row for each posting."""
    return blocks.select(*cols, F.explode(F.flatten("entries")).alias("e")).select(*cols, "e.*")


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """rows, broadcast if there are but a few."""
    return F.broadcast(rows) if n <= MOST_SENT else rows


def _reaches(score: str) -> Column:
    """Whether a score can be among the best: ranks go by scores of six digits, so what is that near below the threshold may tie."""
    return F.coalesce(F.col(score) >= F.col("threshold") - 2e-6, F.lit(True))


def _score(now: Stats, how: Blend) -> Column:
    return F.sum(F.col("weight") * saturated(F.col("term_freq"), F.col("dl"), now, how)).alias("bm25")


def saturated(tf: Column, dl: Column, now: Stats, how: Blend) -> Column:
    average = now.length / now.docs if now.docs else 1.0
    return tf * (how.k1 + 1) / (tf + how.k1 * (1 - how.b + how.b * dl / average))
