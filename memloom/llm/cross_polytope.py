"""Approximate nearest neighbours by largest inner product: cross-polytope hashing.

Vectors of length 1 are turned by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and belong to
the nearest signed axis, in each of several tables; cells of large corpora are pairs and triples of axes, so that a cell has
about `cell` rows at any size. Vectors of different lengths get one more component, which makes all lengths alike and keeps
the order of inner products. A query looks into the cells of its nearest axes in every table (multiprobe), and what it finds
there is ranked by exact inner products of the original vectors, in double precision.

How many cells to probe is fitted: `sample` queries are compared with all rows, and as many cells of a table are probed as
reach the share `target` of their true neighbours. All rows are indexed.

Rows that are alike in all components are indexed as the k + 1 smallest of their ids, which loses no result. Large cells are
split in blocks of rows and of queries, and each pair of blocks is a task of its own; a task hands on k + 1 rows a query.

Nulls and odd rows: rows with a null id or vector, with a component that is null or not finite, and zero vectors take no
part. Of rows with one id that with the smallest vector takes part. Shorter vectors end in zeros. Ties go to the smaller id.
A table without rows, or without queries, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import cut, own


@dataclass(frozen=True)
class Search:
    k: int = 20
    tables: int = 8
    #: Share of the sampled queries' true neighbours that the probes reach; queries that are sampled.
    target: float = 0.96
    sample: int = 192
    #: Rows of a cell, on average; rows and queries of a block.
    cell: int = 1024
    rows: int = 4096
    queries: int = 1024
    seed: int = 7


class Rotations:
    """The tables' pseudo-rotations, and the cells of a table: signed axes of one rotation, or of several at once."""

    def __init__(self, how: Search, dims: int, count: int):
        self.dims = 1 << max(1, (dims - 1).bit_length())
        self.parts, cells = [self.dims], 2 * self.dims  # axes of each rotation that count
        while cells * how.cell < count:
            more = min(self.dims, 1 << max(0, (count // (how.cell * cells)).bit_length() - 1))
            self.parts.append(more)
            cells *= 2 * more
        self.cells = cells
        rng = np.random.default_rng(how.seed)
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (how.tables, len(self.parts), 3, self.dims))

    def turned(self, unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
        x = unit
        for s in signs:
            x, h = x * s, 1
            while h < self.dims:
                x = x.reshape(len(unit), -1, 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(unit), self.dims)
                h *= 2
            x *= np.float32(self.dims**-0.5)
        return x

    def misses(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """For each part, how far each signed axis is from being the nearest (squared): axis a at 2a, its opposite at 2a + 1."""
        out = []
        for axes, signs in zip(self.parts, self.signs[table], strict=True):
            y = self.turned(unit, signs)[:, :axes]
            both = np.stack([y, -y], 2).reshape(len(unit), -1)
            out.append((both.max(1, keepdims=True) - both) ** 2)
        return out

    def cell(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), np.int64)
        for miss in self.misses(unit, table):
            code = code * miss.shape[1] + miss.argmin(1)
        return code

    def probes(self, unit: np.ndarray, table: int, most: int) -> np.ndarray:
        """The `most` cells whose misses sum to least, a row for each vector."""
        total, code = np.zeros((len(unit), 1), np.float32), np.zeros((len(unit), 1), np.int64)
        for miss in self.misses(unit, table):
            near = np.argsort(miss, 1, kind="stable")[:, :most]
            total = (total[:, :, None] + np.take_along_axis(miss, near, 1)[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * miss.shape[1] + near[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(total, 1, kind="stable")[:, :most]
            total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        return code


def vectors_of(frame: pd.DataFrame, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(frame["b"])).reshape(len(frame), dims)


def unit(v: np.ndarray, longest: float) -> np.ndarray:
    """v scaled to length 1; where longest isn't 0, to at most 1 of that length, with what is missing as one more component."""
    size = np.sqrt((v * v).sum(1, keepdims=True))
    if not longest:
        return (v / size).astype(np.float32)
    return np.concatenate([v / longest, np.sqrt(np.maximum(0, 1 - (size / longest) ** 2))], 1).astype(np.float32)


def asking(v: np.ndarray, longest: float) -> np.ndarray:
    u = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
    return np.concatenate([u, np.zeros((len(u), 1), np.float32)], 1) if longest else u


def padded(u: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(u, ((0, 0), (0, dims - u.shape[1])))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    found = rows.select(own(rows, "vec_id").alias("vec_id"), own(rows, "embedding").cast("array<double>").alias("embedding"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return found.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def best_of(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of q its k best rows of v: position of the query, ids, scores. Products choose rows, with room for their rounding; scores are summed row by row, alike wherever a pair meets."""
    rough = q @ v.T
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max(initial=0))
    edge = np.partition(rough, -k, 1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    for i in range(len(q)):
        some = np.flatnonzero(rough[i] >= edge[i] - slack[i])
        score = (v[some] * q[i]).sum(1)
        by = np.lexsort((ids[some], -score))[:k]
        yield i, ids[some][by], score[by]


def _packed(dims: int) -> Callable:
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.zeros((len(f), dims))
            for i, v in enumerate(f["embedding"]):
                out[i, : len(v)] = v
            out += 0.0  # no negative zeros: vectors that are alike have the same bytes
            yield pd.DataFrame({"vec_id": f["vec_id"], "b": [x.tobytes() for x in out], "size": np.sqrt((out * out).sum(1))})

    return pack


def _cells(dims: int, turn: Rotations, longest: float, tables: int, probes: int) -> Callable:
    """Rows with the cells that they are in (probes 0) or, as queries, look into, one number for each table and cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 2048 if not probes else 256):
                f = whole.iloc[at : at + (2048 if not probes else 256)]
                v = vectors_of(f, dims)
                u = padded(asking(v, longest) if probes else unit(v, longest), turn.dims)
                codes = [turn.probes(u, t, probes) if probes else turn.cell(u, t)[:, None] for t in range(tables)]
                all_of = np.concatenate([c + t * turn.cells for t, c in enumerate(codes)], 1)
                yield pd.DataFrame({"vec_id": f["vec_id"], "b": f["b"], "cells": list(all_of)})

    return run


def _exact(sampled: list, dims: int, k: int) -> Callable:
    """Of a task's rows the k best for each sampled query."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = np.frombuffer(b"".join(b for _, b in sampled)).reshape(-1, dims)
        held = {i: (np.zeros(0, np.int64), np.zeros(0)) for i in range(len(q))}
        for whole in frames:
            for at in range(0, len(whole), 4096):
                f = whole.iloc[at : at + 4096]
                for i, near, score in best_of(q, vectors_of(f, dims), f["vec_id"].to_numpy(), k):
                    near, score = np.concatenate([held[i][0], near]), np.concatenate([held[i][1], score])
                    by = np.lexsort((near, -score))[:k]
                    held[i] = near[by], score[by]
        for i, (near, score) in held.items():
            yield pd.DataFrame({"query": sampled[i][0], "vec_id": near, "score": score})

    return run


def fitted_probes(rows: DataFrame, asked: DataFrame, dims: int, turn: Rotations, longest: float, how: Search) -> int:
    """Cells of a table to probe, so that the sampled queries' neighbours among all rows are reached as often as how.target."""
    sampled = [(r["vec_id"], bytes(r["b"])) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample).select("vec_id", "b").collect()]
    if not sampled:
        return 1
    near = rows.mapInPandas(_exact(sampled, dims, how.k + 1), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= how.k + 1).where("query <> vec_id")
    true = top.join(rows.select("vec_id", "b"), "vec_id").select("query", "b").collect()  # sample * (k + 1) rows at most
    if not true:
        return 1
    place = {q: i for i, (q, _) in enumerate(sampled)}
    of = np.array([place[r["query"]] for r in true])
    q = padded(asking(np.frombuffer(b"".join(b for _, b in sampled)).reshape(-1, dims), longest), turn.dims)
    v = padded(unit(np.frombuffer(b"".join(bytes(r["b"]) for r in true)).reshape(-1, dims), longest), turn.dims)
    cells = [turn.cell(v, t) for t in range(how.tables)]
    most = 1
    while True:  # doubled until enough are reached, then the smallest number that does
        rank = np.full(len(true), turn.cells)
        for t in range(how.tables):
            hit = turn.probes(q, t, most)[of] == cells[t][:, None]
            rank = np.where(hit.any(1), np.minimum(rank, hit.argmax(1)), rank)
        if (rank < most).mean() >= how.target or most >= turn.cells:
            return int(np.sort(rank)[int(np.ceil(how.target * len(rank))) - 1]) + 1
        most = min(turn.cells, 2 * most)


def nearest(rows: DataFrame, queries: Column, how: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: of each row where `queries` holds, the k nearest of the other rows (vec_id, embedding)."""
    rows = usable(rows)
    rows = cut(rows)
    dims = max(1, rows.agg(F.max(F.size("embedding"))).head()[0] or 1)
    rows = rows.mapInPandas(_packed(dims), "vec_id long, b binary, size double")
    alike = Window.partitionBy("b").orderBy("vec_id")
    held = cut(rows.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= how.k + 1).drop("_r"))
    all_asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "b")
    asked = cut(all_asked.groupBy("b").agg(F.min("query_id").alias("vec_id")))
    count, short, long = held.agg(F.count("*"), F.min("size"), F.max("size")).head()
    longest = 0.0 if not count or long <= short * (1 + 1e-6) else long
    turn = Rotations(how, dims + bool(longest), count)
    probes = fitted_probes(held, asked, dims, turn, longest, how)
    celled = cut(held.mapInPandas(_cells(dims, turn, longest, how.tables, 0), "vec_id long, b binary, cells array<long>"))
    looking = cut(asked.mapInPandas(_cells(dims, turn, longest, how.tables, probes), "vec_id long, b binary, cells array<long>"))
    sizes = [x.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name)) for x, most, name in ((celled, how.rows, "row_blocks"), (looking, how.queries, "query_blocks"))]
    grid = sizes[0].join(sizes[1], "cell")
    dealt = []
    for side, mine, other in ((celled, "row_blocks", "query_blocks"), (looking, "query_blocks", "row_blocks")):
        each = side.select("vec_id", "b", F.explode("cells").alias("cell")).join(grid, "cell")
        each = each.withColumns({mine + "_at": F.pmod(F.xxhash64("vec_id", "cell"), F.col(mine)).cast("int"), other + "_at": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        dealt.append(each.select("cell", "row_blocks_at", "query_blocks_at", "vec_id", "b").groupBy("cell", "row_blocks_at", "query_blocks_at"))

    def ranked(near: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(near) or not len(asks):
            return pd.DataFrame({"query": [], "ids": [], "scores": []})
        found = list(best_of(vectors_of(asks, dims), vectors_of(near, dims), near["vec_id"].to_numpy(), how.k + 1))
        return pd.DataFrame({"query": asks["vec_id"].to_numpy(), "ids": [x[1] for x in found], "scores": [x[2] for x in found]})

    found = dealt[0].cogroup(dealt[1]).applyInPandas(ranked, "query long, ids array<long>, scores array<double>")
    each = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    once = each.repartition("query").dropDuplicates(["query", "vec_id"])
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= how.k + 1)
    named = all_asked.join(asked.withColumnRenamed("vec_id", "query"), "b").select("query_id", "query")
    theirs = named.join(top, "query").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("_r")
    return theirs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
