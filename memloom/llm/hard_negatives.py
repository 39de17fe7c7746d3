"""Hard negatives: for each anchor and its nearest rows of the same label, rows of other labels that score nearly as high.

Scores are inner products of whole numbers, and all rows above a threshold are found by a join with an inverted index, block
of anchors by block of rows. The index omits a row's leading dimensions as long as they alone can't reach the lowest
threshold (product of the norms of the leading parts). Scores are accumulated slab of dimensions by slab, and a pair goes
once its sum and the product of the norms of what remains stay below the anchor's threshold. Thresholds start high and are
lowered until the anchor's window is full: five rows of its label, then five of other labels below each of those. A task
keeps what it has for each anchor, so later blocks begin where the window was filled. Nothing is left out on the way: all
bounds are exact, and a window that never fills is searched to its end.

Two passes. Rows and anchors of a label meet first: labels go to buckets of about a block's rows, and blocks are joined by
bucket; a bucket of many rows has many blocks. Then blocks of anchors, with the scores of their positives, meet blocks of
all rows: a query set against all rows, in blocks. Anchors are sent to all tasks up to MOST_SENT of them, beyond that the
blocks are shuffled.

Nulls and odd rows: rows with a null id, label or vector, or with a component that is null or not finite, take no part. Of
rows with one id that with the smallest label, then vector, takes part, so repeated rows count once. Shorter vectors end in
zeros; an empty one scores 0. Ties go to the smaller id. Scores are exact below 2^53 in absolute value. An anchor without
positives that score 0 or more has no rows: windows of negative scores are empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import cut, own


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    #: A negative's score in hundredths of the positive's, from and to.
    low: int = 80
    high: int = 100
    #: Rows and anchors of a block, dimensions of a slab.
    rows: int = 4096
    anchors: int = 512
    slab: int = 8


#: Anchors up to which their blocks are broadcast; pairs that a task keeps before it hands them on.
MOST_SENT, MOST_KEPT = 16_384, 500_000


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    found = rows.select(*[own(rows, c).alias(c) for c in ("vec_id", "label", "embedding")])
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    found = found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_m")).select("vec_id", "_m.label", "_m.embedding")


def scaled(frames: Iterable[list], dims: int, scale: float) -> np.ndarray:
    """Vectors as rows of whole numbers, floor(scale * x), ended with zeros."""
    vectors = list(frames)
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.clip(np.floor(out * scale), -(2.0**500), 2.0**500)


def _packer(dims: int, scale: float, most: int, key: str | None = None, more: tuple[str, ...] = ()) -> Callable:
    """Blocks of up to `most` rows, of one value of key each if there is one."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(k, f: pd.DataFrame) -> pd.DataFrame:
            head = ({key: [k]} if key else {}) | {c: [f[c].tolist()] for c in more}
            return pd.DataFrame({**head, "labels": [f["label"].tolist()], "ids": [f["vec_id"].tolist()], "m": [scaled(f["embedding"], dims, scale).tobytes()]})

        held: dict = {}
        for frame in frames:
            for k, f in frame.groupby(key, sort=False) if key else [(None, frame)]:
                f = pd.concat([held.pop(k), f]) if k in held else f
                while len(f) >= most:
                    yield block(k, f.iloc[:most])
                    f = f.iloc[most:]
                if len(f):
                    held[k] = f
            while sum(map(len, held.values())) > 4 * most:  # the fullest goes as it is
                k = max(held, key=lambda x: len(held[x]))
                yield block(k, held.pop(k))
        for k, f in held.items():
            yield block(k, f)

    return pack


def above(q: np.ndarray, v: np.ndarray, least: np.ndarray, slab: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (anchor, row, score) with score >= least[anchor], of anchors q and rows v (whole numbers, a row each)."""
    order = np.argsort((q * q).sum(0), kind="stable")  # heavy dimensions last: they are accumulated first
    q, v = q[:, order], v[:, order]
    dims = q.shape[1]
    edges = [*range(0, dims, slab), dims]
    last = len(edges) - 1
    nq, nv = (np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], 1))[:, edges] for x in (q, v))
    slack = 0.5 + 1e-9 * float(nq[:, -1].max(initial=0)) * float(nv[:, -1].max(initial=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(nq > 0, (least - slack)[:, None] / nq, np.where(least - slack > 0, np.inf, 0.0)[:, None]).min(0)
    omitted = (nv < np.maximum(room, 0))[:, 1:].sum(1)  # leading slabs that the index leaves out
    by = np.argsort(omitted, kind="stable")
    v, nv, omitted = v[by], nv[by], omitted[by]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def finish(a: np.ndarray, r: np.ndarray, score: np.ndarray, k: int) -> None:
        """Pairs that are accumulated down to slab k."""
        for j in range(k - 1, -1, -1):
            part = slice(edges[j], edges[j + 1])
            score = score + (q[a, part] * v[r, part]).sum(1)
            stays = score + nq[a, j] * nv[r, j] >= least[a] - slack
            a, r, score = a[stays], r[stays], score[stays]
        stays = score >= least[a]
        found.append((a[stays], by[r[stays]], score[stays]))

    n = int(np.searchsorted(omitted, last - 1, "right"))
    sums = np.zeros((len(q), n))
    for k in range(last - 1, -1, -1):
        listed = int(np.searchsorted(omitted, k, "right"))
        for at in range(listed, n, 512):  # these rows have no entries in this slab and before it
            some = slice(at, min(n, at + 512))
            a, r = np.nonzero(sums[:, some] + nq[:, k + 1, None] * nv[some, k + 1] >= (least - slack)[:, None])
            finish(a, r + at, sums[a, r + at], k + 1)
        n = listed
        sums = sums[:, :n]
        if not n:
            break
        part = slice(edges[k], edges[k + 1])
        sums += q[:, part] @ v[:n, part].T
        if k <= last // 2:
            alive = sums + nq[:, k, None] * nv[:n, k] >= (least - slack)[:, None]
            if not k or np.count_nonzero(alive) * 16 < alive.size:
                a, r = np.nonzero(alive)
                finish(a, r, sums[a, r], k)
                break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def lowered(q: np.ndarray, v: np.ndarray, start: np.ndarray, floor: np.ndarray, factor: float, counts: Callable, enough: np.ndarray, slab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """above(), its thresholds lowered from start by factor, down to floor, until counts() of an anchor's pairs are enough."""
    todo, least, out = np.arange(len(q)), np.maximum(start, floor), []
    while len(todo):
        a, r, score = above(q[todo], v, least[todo], slab)
        have = np.bincount(a[counts(todo[a], r, score)], minlength=len(todo))
        over = (have >= enough[todo]) | (least[todo] <= floor[todo])
        done = over[a]
        out.append((todo[a[done]], r[done], score[done]))
        todo = todo[~over]
        lower = np.floor(least[todo] * factor)
        least[todo] = np.maximum(floor[todo], np.where(lower < 0.05 * start[todo], -np.inf, lower))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def ranked(a: np.ndarray, keep: np.ndarray, most: int) -> np.ndarray:
    """Of rows that are ordered by anchor a, and count where keep holds, whether each is among the first `most` of its anchor."""
    total = np.cumsum(keep)
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    before = np.repeat(total[first] - keep[first], np.diff(np.r_[first, len(a)]))
    return keep & (total - before <= most)


class _Kept:
    """What a task has for the anchors of one block: pairs that may still be among the results."""

    def __init__(self, how: Mining, size: int, limits: np.ndarray | None):
        self.how, self.size, self.limits = how, size, limits
        self.a, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        a, score, ids = np.concatenate([self.a, a]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        by = np.lexsort((ids, -score, a))
        a, score, ids = a[by], score[by], ids[by]
        if self.limits is None:
            stays = ranked(a, np.ones(len(a), bool), self.how.positives)
        else:
            stays = np.zeros(len(a), bool)
            for p in self.limits.T:  # of one positive each; NaN where there is none
                stays |= ranked(a, self._in(score, p[a]), self.how.negatives)
        self.a, self.score, self.id = a[stays], score[stays], ids[stays]

    def _in(self, score: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (self.how.low * p <= 100 * score) & (100 * score <= self.how.high * p)

    def floor(self, base: np.ndarray, top: np.ndarray) -> np.ndarray:
        """base, or the last score of a window that is full: of scores up to top."""
        most = self.how.positives if self.limits is None else self.how.negatives
        keep = 100 * self.score <= top[self.a]
        inside = ranked(self.a, keep, most)
        full = np.bincount(self.a[inside], minlength=self.size) >= most
        worst = np.full(self.size, np.inf)
        np.minimum.at(worst, self.a[inside], self.score[inside])
        return np.where(full, np.maximum(base, worst), base)


def _task(dims: int, how: Mining, negatives: bool) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for ids, kept in held.values():
                yield pd.DataFrame({"anchor_id": ids[kept.a], "vec_id": kept.id, "score": np.clip(kept.score, -(2.0**62), 2.0**62).astype(np.int64)})
            held.clear()

        for f in frames:
            for row in f.to_dict("records"):
                q_ids, v_ids = (np.asarray(row[c], np.int64) for c in ("q_ids", "v_ids"))
                q, v = (np.frombuffer(row[c]).reshape(-1, dims) for c in ("q_m", "v_m"))
                key = (int(q_ids[0]), len(q_ids))
                if key not in held:
                    limits = np.array([[*p, *[np.nan] * (how.positives - len(p))] for p in row["q_positives"]], np.float64) if negatives else None
                    held[key] = (q_ids, _Kept(how, len(q_ids), limits))
                kept = held[key][1]
                q_labels, v_labels = np.asarray(row["q_labels"]), np.asarray(row["v_labels"])
                counted = pd.Series(v_labels).value_counts()
                alike = counted.reindex(q_labels, fill_value=0).to_numpy()
                if negatives:
                    least = np.nanmin(kept.limits, 1)
                    base, top = np.ceil(how.low * least / 100), how.high * least
                    start, factor = np.floor(0.97 * how.high * least / 100), 0.94
                    enough = np.minimum(how.negatives, len(v) - alike)
                else:
                    base, top = np.zeros(len(q)), np.full(len(q), np.inf)
                    start, factor = 0.6 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max()), 0.75
                    enough = np.minimum(how.positives, alike - np.isin(q_ids, v_ids))
                fits = lambda a, r, q_labels=q_labels, v_labels=v_labels, q_ids=q_ids, v_ids=v_ids: (q_labels[a] != v_labels[r]) if negatives else (q_labels[a] == v_labels[r]) & (q_ids[a] != v_ids[r])
                counts = lambda a, r, s, fits=fits, top=top: fits(a, r) & (100 * s <= top[a])
                floor = kept.floor(base, top)
                start = np.where(floor > base, floor, np.maximum(start, base))
                some = np.flatnonzero(enough > 0)
                if not len(some):
                    continue
                a, r, score = lowered(q[some], v, start[some], floor[some], factor, lambda a, r, s, some=some, counts=counts: counts(some[a], r, s), enough[some], how.slab)
                a = some[a]
                mine = fits(a, r)
                a, r, score = a[mine], r[mine], score[mine]
                kept.add(a, score, v_ids[r])
                if sum(len(k.a) for _, k in held.values()) > MOST_KEPT:
                    yield from flushed()
        yield from flushed()

    return run


_FOUND = "anchor_id long, vec_id long, score long"


def mine(rows: DataFrame, anchors: Column, scale: float = 1.0, how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor: rows (vec_id, label, embedding) where `anchors` holds."""
    rows = cut(usable(rows))
    n, dims = rows.agg(F.count("*"), F.max(F.size("embedding"))).head()
    dims, labels = max(1, dims or 1), rows.schema["label"].dataType.simpleString()
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(-(-n // how.rows) or 1)))  # labels of about a block's rows together
    asked = cut(rows.where(anchors))
    asking = asked.count()
    few, plain = asking <= MOST_SENT, f"labels array<{labels}>, ids array<long>, m binary"
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts, blocks = max(-(-n // (4 * how.rows)), min(cores, -(-n // 1024)), 1), max(-(-asking // (4 * how.anchors)), 1)
    named = {"labels": "v_labels", "ids": "v_ids", "m": "v_m"}, {"labels": "q_labels", "ids": "q_ids", "m": "q_m"}
    by_bucket = [x.repartitionByRange(k, "bucket", "vec_id").mapInPandas(_packer(dims, scale, most, "bucket"), "bucket long, " + plain).withColumnsRenamed(as_) for x, k, most, as_ in ((rows, parts, how.rows, named[0]), (asked, blocks, how.anchors, named[1]))]
    alike = by_bucket[0].join(F.broadcast(by_bucket[1]) if few else by_bucket[1], "bucket").drop("bucket")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = alike.mapInPandas(_task(dims, how, False), _FOUND)
    positives = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= how.positives))
    limits = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list("score")).alias("positives"))
    aimed = asked.join(limits, "vec_id").select("vec_id", "label", "embedding", "positives")
    sent = aimed.repartition(blocks).mapInPandas(_packer(dims, scale, how.anchors, None, ("positives",)), "positives array<array<long>>, " + plain).withColumnsRenamed({"positives": "q_positives", **named[1]})
    held = rows.repartition(parts).mapInPandas(_packer(dims, scale, how.rows), plain).withColumnsRenamed(named[0])
    pairs = held.crossJoin(F.broadcast(sent) if few else sent)
    near = pairs.mapInPandas(_task(dims, how, True), _FOUND).select("anchor_id", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(near, "anchor_id")
    both = both.where((how.low * F.col("positive_score") <= 100 * F.col("negative_score")) & (100 * F.col("negative_score") <= how.high * F.col("positive_score")))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
