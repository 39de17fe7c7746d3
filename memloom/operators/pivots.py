"""Exact nearest neighbours by cosine, with pivots: blocks of vectors that angles rule out are not read.

Some vectors serve as pivots. Each vector belongs to the pivot that is nearest to it, and each pivot's vectors are cut into
blocks by their angle to it. With angle a from a query to the pivot, no vector of a block whose angles are lo to hi is
nearer to the query than max(a - hi, lo - a). The blocks that are nearest by this bound give a query its first k
neighbours, and only blocks whose bound reaches the last of those are compared. The results are those of comparing all.

Pivots are broadcast (their number is a parameter), and so are the blocks' headers, a row for each, up to MOST_SENT of them;
beyond that blocks are made larger. Null vectors take no part; a vector of no length scores 0 with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.lineage import cut


@dataclass(frozen=True)
class Pivots:
    #: Pivots at most; vectors of a block, about; blocks that a query looks at first.
    pivots: int = 256
    block: int = 1024
    first: int = 2
    #: Queries of a block that are multiplied at once.
    queries: int = 1024


#: Headers of blocks that are broadcast at most; queries that are compared with a block in one task.
MOST_SENT, MOST_ASKED = 500_000, 65_536
#: Scores are ranked by six digits, so a block that is this near below the threshold may hold a tie.
MARGIN = 2e-6


def _units(column: pd.Series, dims: int) -> np.ndarray:
    m = np.array([v if len(v) == dims else np.resize(np.append(v, np.zeros(dims)), dims) for v in (np.asarray(x, np.float64) for x in column)]).reshape(-1, dims)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.where(size > 1e-12, m / np.maximum(size, 1e-12), 0.0)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def best_by_six_digits(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score of six digits, then id."""
    return np.lexsort((ids, -np.round(scores, 6)))[:k]


def _assigned(pivots: np.ndarray, dims: int) -> Callable:
    """id, unit (bytes), pivot, angle to it; vectors of no length have pivot -1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            u = _units(f["embedding"], dims)
            cos = u @ pivots.T
            near = cos.argmax(1)
            none = ~u.any(1)
            yield pd.DataFrame({"id": f["id"], "unit": [x.tobytes() for x in u], "pivot": np.where(none, -1, near), "angle": np.where(none, 0.0, _angle(cos[np.arange(len(u)), near]))})

    return run


class Bounds:
    """The blocks' headers, and what a query can find in each at most."""

    def __init__(self, pivots: np.ndarray, heads: pd.DataFrame):
        self.pivots, self.block = pivots, heads["block"].to_numpy()
        self.pivot, self.lo, self.hi = (heads[c].to_numpy() for c in ("pivot", "lo", "hi"))

    def of(self, q: np.ndarray) -> np.ndarray:
        """Cosine bound for each query and block."""
        a = _angle(q @ self.pivots.T)[:, np.maximum(self.pivot, 0)]
        gap = np.maximum(np.maximum(a - self.hi, self.lo - a), 0)
        bound = np.cos(np.minimum(gap, np.pi)) + 1e-12
        return np.where((self.pivot < 0) | ~q.any(1)[:, None], 1e-12, bound)


def blocks(vectors: DataFrame, how: Pivots) -> tuple[DataFrame, Bounds, int]:
    """vectors (id, embedding) with their units, pivots, angles and blocks; the bounds; the number of components."""
    there = vectors.where(F.col("embedding").isNotNull())
    n, dims = there.agg(F.count("*"), F.max(F.size("embedding"))).head()
    dims = max(1, dims or 1)
    some = there.orderBy(F.xxhash64("id"), "id").limit(max(1, min(how.pivots, n // how.block))).select("embedding").toPandas()
    pivots = _units(some["embedding"], dims) if len(some) else np.zeros((1, dims))
    held = there.select("id", "embedding").mapInPandas(_assigned(pivots, dims), f"id {vectors.schema['id'].dataType.simpleString()}, unit binary, pivot int, angle double")
    # blocks of a pivot: ranges of angle with about as many vectors each, placed by a histogram so that no pivot is one group
    size = max(how.block, -(-n // MOST_SENT))
    held = cut(held.withColumn("step", F.floor(F.col("angle") * 4096 / np.pi).cast("int")))
    steps = held.groupBy("pivot", "step").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))  # 4,097 rows a pivot at most
    placed = steps.withColumn("band", F.floor(F.coalesce(before, F.lit(0)) / size)).withColumn("split", F.ceil(F.col("n") / size).cast("int"))
    held = held.join(placed.drop("n"), ["pivot", "step"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("split")))
    held = cut(held.withColumn("block", F.xxhash64("pivot", "band", F.when(F.col("split") > 1, F.col("part")).otherwise(-1))).select("id", "unit", "pivot", "angle", "block"))
    heads = held.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).toPandas()  # MOST_SENT rows and a few for each pivot
    return held, Bounds(pivots, heads), dims


def _nearest_blocks(bounds: Bounds, dims: int, first: int) -> Callable:
    """query_id, unit, block of the first blocks of each query; or with first 0 of all whose bound reaches the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 256):
                f = whole.iloc[at : at + 256]
                q = np.frombuffer(b"".join(f["unit"])).reshape(-1, dims)
                b = bounds.of(q)
                if first:
                    near = np.argsort(-b, 1, kind="stable")[:, :first]
                    rows = np.repeat(np.arange(len(f)), near.shape[1])
                    cols = near.reshape(-1)
                else:
                    rows, cols = np.nonzero(b >= f["least"].to_numpy()[:, None] - MARGIN)
                yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[rows], "unit": f["unit"].to_numpy()[rows], "block": bounds.block[cols]})

    return run


def _compared(dims: int, k: int, how: Pivots, kinds: tuple[str, str]) -> tuple[Callable, str]:
    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(rows) and len(asks):
            v, ids = np.frombuffer(b"".join(rows["unit"])).reshape(-1, dims), rows["id"].to_numpy()
            for at in range(0, len(asks), how.queries):
                f = asks.iloc[at : at + how.queries]
                scores = np.frombuffer(b"".join(f["unit"])).reshape(-1, dims) @ v.T
                for name, row in zip(f["query_id"], scores, strict=True):
                    best = best_by_six_digits(row, ids, k)
                    out["query_id"] += [name] * len(best)
                    out["id"] += ids[best].tolist()
                    out["score"] += row[best].tolist()
        return pd.DataFrame(out)

    return run, "query_id {}, id {}, score double".format(*kinds)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, how: Pivots = Pivots()) -> DataFrame:
    """The k nearest of vectors (id, embedding) to each of queries (query_id, embedding): query_id, id, score, rank; ranked by score of six digits, then id."""
    return search(vectors, queries, k, how)[0]


def search(vectors: DataFrame, queries: DataFrame, k: int, how: Pivots = Pivots()) -> tuple[DataFrame, DataFrame]:
    """knn(), and query_id, block of the comparisons that angles didn't rule out."""
    held, bounds, dims = blocks(vectors, how)
    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "unit": [x.tobytes() for x in _units(f["embedding"], dims)]})

    asked = cut(queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding").mapInPandas(unit, f"query_id {kinds[0]}, unit binary"))
    copies = max(1, -(-asked.count() // MOST_ASKED))  # of each block, so that a block all queries look at is no single task

    to = f"query_id {kinds[0]}, unit binary, block long"
    compare, found = _compared(dims, k, how, kinds)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "id")

    def ranked(looking: DataFrame) -> DataFrame:
        each = held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("block", "copy")
        asks = looking.withColumn("copy", F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int")).groupBy("block", "copy")
        near = each.cogroup(asks).applyInPandas(compare, found)
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = ranked(asked.mapInPandas(_nearest_blocks(bounds, dims, how.first), to))
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    limits = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    chosen = limits.mapInPandas(_nearest_blocks(bounds, dims, 0), to)
    return ranked(chosen), chosen.select("query_id", "block")
