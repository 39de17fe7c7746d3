"""SimHash near-duplicates by a sharded vantage-point tree.

Equal fingerprints are one point. The top of a tree, made from a bounded sample, deals the points to shards: at each node a
point goes left if its Hamming distance to the node's vantage point is at most the median, else right; by the triangle
inequality, points that far apart from the boundary that they cannot link to the other side stay on their own, and a left
point within `most` of it goes right as well. So every linked pair meets in a shard. Shards are split further in their task
in the same way, with distances counted in blocks at the leaves; a large cluster that no vantage point splits is linked by
looking up what is within `most` bits of each of its points. A shard returns not its pairs but a spanning forest of
them: at most one edge a point, however large a group of near copies is. Components come from alternating large-star and
small-star steps over those edges, with nothing gathered on the driver.

Defined results: a null text is empty and has fingerprint zero; repeated rows count as copies; ids that are null never become
a component's id unless it has no other; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut, own, packed

SHINGLE, SEED, MOST = 3, 42, 2
#: Points of the sample that the top of the tree is made from, points meant for a shard, depth of the top at most, points of a leaf, and of a cluster whose pairs are still counted out.
SAMPLE, SHARD, DEEPEST, LEAF, CLUSTER = 40_000, 600, 14, 1024, 4096
_hash = partial(xxhash.xxh64_digest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half of the hashes of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    n, total = 0, np.zeros(64, np.int64)
    digests = np.frombuffer(b"".join(map(_hash, shingles)), np.uint8).reshape(-1, 8)
    for i in range(0, len(digests), 1 << 16):
        part = digests[i : i + (1 << 16)]
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fp, the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", of("text"))


def far(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one)


def top(sample: np.ndarray, depth: int, seed: int = 5) -> list[tuple[int, int]]:
    """(vantage point, median) of the nodes of a full binary tree in order of level; children of i: 2i + 1, 2i + 2."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int]] = []
    level = [sample]
    for _ in range(depth):
        below = []
        for part in level:
            few = part[rng.integers(0, len(part), 8)] if len(part) else rng.integers(0, 1 << 63, 1).astype(np.uint64)
            spread = [far(part, v).std() if len(part) else 0 for v in few]
            v = few[int(np.argmax(spread))]
            d = far(part, v)
            mu = int(np.median(d)) if len(part) else 32
            nodes.append((int(v), mu))
            below += [part[d <= mu], part[d > mu]]
        level = below
    return nodes


def shards(points: np.ndarray, nodes: list[tuple[int, int]], depth: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(index of a point, shard): each point's own shard, and those beyond a boundary that it is near."""
    which, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    v, mu = (np.array(x) for x in zip(*nodes, strict=True)) if nodes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(depth):
        d = np.bitwise_count(points[which] ^ v.astype(np.uint64)[node]).astype(np.int64)
        left, near = d <= mu[node], (d <= mu[node]) & (d > mu[node] - most)
        which, node = np.concatenate([which, which[near]]), np.concatenate([2 * node + 2 - left, 2 * node[near] + 2])
    return which, node - ((1 << depth) - 1)


def forest(points: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the pairs within `most` bits."""
    label = np.arange(len(points))
    edges: list[tuple[int, int]] = []

    def block(at: np.ndarray) -> None:
        mine = points[at]
        for i in range(0, len(at), 128):
            near = np.bitwise_count(mine[i : i + 128, None] ^ mine[None, :]) <= most
            for k in np.flatnonzero(near.sum(1) > 1):
                them = at[near[k]]
                labels = label[them]
                if (labels != labels[0]).any():
                    own = label[at[i + k]]
                    kinds, first = np.unique(labels, return_index=True)
                    edges.extend((int(at[i + k]), int(them[j])) for c, j in zip(kinds, first, strict=True) if c != own)
                    label[np.isin(label, kinds)] = kinds[0]

    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) > LEAF:
            halves = _halves(points, at, most)
            if max(map(len, halves)) <= 0.9 * len(at):
                stack += halves
                continue
        if len(at) > CLUSTER:
            edges += _around(points, at, label, most)
        else:
            block(at)
    return edges


def _halves(points: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
    """The best split by one of a few vantage points: those up to its median distance, and those beyond or near that."""
    best = [at]
    for v in points[at[np.linspace(0, len(at) - 1, 6).astype(np.int64)]]:
        d = far(points[at], v).astype(np.int64)
        mu = int(np.median(d))
        halves = [at[d <= mu], at[d > mu - most]]
        if max(map(len, halves)) < max(map(len, best)):
            best = halves
    return best


def _around(points: np.ndarray, at: np.ndarray, label: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges within a cluster that no vantage point splits: a look-up of every value within `most` bits of each point, so its cost is linear. Updates label."""
    at = at[np.argsort(points[at], kind="stable")]
    mine, root, edges = points[at], label[at], []
    names, before = np.unique(root, return_inverse=True)
    root = before
    for k in range(1, most + 1):
        for bits in combinations(range(64), k):
            with_them = mine ^ np.uint64(sum(1 << b for b in bits))
            i = np.minimum(np.searchsorted(mine, with_them), len(mine) - 1)
            left = np.flatnonzero(mine[i] == with_them)
            right = i[left]
            while len(left):
                a, b = root[left], root[right]
                apart = np.flatnonzero(a != b)
                left, right = left[apart], right[apart]
                high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
                chosen, first = np.unique(high, return_index=True)
                edges += [(int(at[x]), int(at[y])) for x, y in zip(left[first], right[first], strict=True)]
                to = np.arange(len(names))
                to[chosen] = low[first]
                while (to != to[to]).any():
                    to = to[to]
                root = to[root]
    to = np.arange(len(names))
    to[before] = root
    known = np.isin(label, names)
    label[known] = names[to[np.searchsorted(names, label[known])]]
    return edges


def links(points: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: edges between fingerprints (column fp, distinct), enough to connect all that link."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, min(DEEPEST, (max(1, n) // SHARD).bit_length()))
    some = points.orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(SAMPLE) if n > SAMPLE else points
    sample = np.array([r["fp"] for r in some.collect()], np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(top(np.sort(sample), depth))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64)
            which, shard = shards(fp.view(np.uint64), held.value, depth, most)
            yield pd.DataFrame({"shard": shard, "fp": fp[which]})

    def within(f: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(f["fp"].to_numpy(np.int64).view(np.uint64))
        pairs = np.array(forest(fp, most), np.int64).reshape(-1, 2)
        both = fp.view(np.int64)[pairs]
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return points.select("fp").mapInPandas(deal, "shard long, fp long").groupBy("shard").applyInPandas(within, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node), for each node of an edge; large-star and small-star until nothing changes."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:  # each round but the last moves an edge to smaller nodes
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def classes(docs: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each of docs: doc_id, mark (a hash of the text), fingerprint (16 hex digits), component_id (the smallest doc_id that links reach), root (the component, also of rows that share an id)."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    marked = cut(with_fingerprints(kept).select("doc_id", "mark", "fp"))
    points = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = cut(components(links(points, most)))
    rooted = points.join(found, points["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id", "root")
    return marked.join(of, "fp").select("doc_id", "mark", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (a null one if there is no other), of its texts one; rows that repeat it count once. Rows that share an id and aren't near copies are components of their own."""
    first = classes(docs, most).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("_m"))
    first = first.select(F.col("_m.doc_id").alias("_id"), F.col("_m.mark").alias("_mark"))
    rows = docs.select(packed(docs), own(docs, "doc_id").alias("_doc"), F.xxhash64(own(docs, "text")).alias("_key"))
    kept = rows.join(first, rows["_doc"].eqNullSafe(first["_id"]) & (rows["_key"] == first["_mark"]), "left_semi")
    return kept.dropDuplicates(["_doc", "_key"]).select("_row.*")
