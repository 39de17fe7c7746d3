"""Exact neighbours with pivots: equal to comparing all, and blocks are ruled out where vectors lie in clusters."""

import numpy as np
import pytest

from memloom.operators import pivots


def brute(rows, queries, k):
    ids = np.array([i for i, v in rows if v is not None])
    v = np.array([v for _, v in rows if v is not None])
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    out = {}
    for name, q in queries:
        if q is not None:
            s = np.round(unit(v) @ unit(np.array(q)), 6)
            out[name] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append(r["id"])
    return out


def tables(spark, rows, queries):
    return spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, embedding array<double>")


@pytest.mark.parametrize("clustered", [True, False])
def test_equal_to_all(spark, clustered):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 6))
    if clustered:
        v = rng.normal(size=(12, 6))[rng.integers(0, 12, 2000)] + 0.05 * v
    v[500:560] = v[500]  # copies, more than k
    v[600:620] = v[500] * (1 + 1e-9 * rng.normal(size=(20, 6)))  # near ties
    v[700:703] = 0
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(5000, None)]
    queries = [(i, v[i].tolist()) for i in range(0, 2000, 40)] + [(9000, [0.0] * 6), (9001, None)]
    how = pivots.Pivots(pivots=32, block=50, queries=7)
    near, chosen = pivots.search(*tables(spark, rows, queries), 10, how)
    assert found(near) == brute(rows, queries, 10)
    _, bounds, _ = pivots.blocks(tables(spark, rows, queries)[0], how)
    share = chosen.count() / (51 * len(bounds.block))
    assert share < (0.3 if clustered else 1.0)


def test_few_and_none(spark):
    rows, queries = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], [(0, [1.0, 0.1])]
    assert found(pivots.knn(*tables(spark, rows, queries), 10)) == {0: [1, 3, 2]}
    assert found(pivots.knn(*tables(spark, [], queries), 10)) == found(pivots.knn(*tables(spark, rows, []), 10)) == {}


def test_ties_in_any_partitioning(spark):
    """A search for one hit gives the head of a search for three, where cosines agree to six digits and more; so does knn."""
    from pyspark.sql import functions as F

    from memloom.operators import retrieval as R

    rng = np.random.default_rng(3)
    base = np.array([1.0, 0.2])
    v = [(base + 1e-7 * rng.normal(size=2)).tolist() if i < 30 else base.tolist() if i < 45 else rng.normal(size=2).tolist() for i in range(90)]
    v[60] = (base + [0, 2e-4]).tolist()
    memories = spark.createDataFrame([(i, "c", x, "same text" if i == 70 else "other words") for i, x in enumerate(v)], "id long, collection string, embedding array<double>, text string")
    queries = spark.createDataFrame([(0, "nothing alike", [1.0, 0.2]), (1, "text", [1.0, 0.2])], "query_id long, text string, embedding array<double>")
    posted = R.postings(memories)
    seen = set()
    for parts in (1, 2, 7):
        m = memories.repartition(parts, F.xxhash64("id"))
        for keyword in (3.0, 0.0):
            hits = {n: sorted((r["query_id"], r["rank"], r["id"]) for r in R.hybrid_search(m, posted, queries, how=R.Blend(limit=n, keyword=keyword, min_score=-1)).collect()) for n in (1, 3, 20)}
            for n in (1, 3):
                assert hits[n] == [x for x in hits[20] if x[1] <= n]
            seen.add((keyword, tuple(hits[20])))
        near = sorted((r["query_id"], r["rank"], r["id"]) for r in R.knn(m.select("id", "embedding"), queries, 3).collect())
        seen.add(("knn", tuple(near)))
    assert len(seen) == 3
    assert [x[2] for x in near if x[0] == 0] == brute([(i, x) for i, x in enumerate(v)], [(0, [1.0, 0.2])], 3)[0]
