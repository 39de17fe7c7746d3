"""Hard negatives, approximate neighbours and spelling variants, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import cross_polytope, hard_negatives, spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs, shortest=7):
    """The contract, word by word and pair by pair."""
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= shortest and n >= 2}
    form, n_near = {}, {}
    for w in known:
        of = [v for v in known if near(w, v)]
        n_near[w] = len(of)
        best = min(of, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 10 * known[w] else None
    out = set()
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], form[w] and known[form[w]]))
    return out


def told(spark, docs, block=None):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "word": F.lit("x"), "run": F.lit(2)})
    words = spelling_variants.runs(df).select(spelling_variants.slipped(F.col("doc_id"), F.col("run")).alias("word"))
    rows = spelling_variants.forms(spelling_variants.vocabulary(words)).collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {tuple(r) for r in rows}


def lettered(rng, n, letters="abc"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)]


def test_pairs_of_one_letter():
    rng = random.Random(3)
    for size in (1, 63, 64, 65, 300):
        asks, held = (sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(size)}, key=len, reverse=True) for _ in range(2))
        q, v = spelling_variants.near_pairs(asks, held)
        assert sorted(zip(q, v, strict=True)) == [(i, j) for i, a in enumerate(asks) for j, b in enumerate(held) if near(a, b)]
    long = ["x" * 3000 + "y", "x" * 3000, "ab"]
    assert sorted(zip(*spelling_variants.near_pairs(long, long), strict=True)) == [(0, 1), (1, 0)]


def test_variants(spark):
    rng = random.Random(5)
    pool = lettered(rng, 120)
    docs = [(i, " ".join(rng.choice(pool[: 1 + (i % 120)]).title() for _ in range(40)) + ", ÉCOLEÉté x" + "z" * 40) for i in range(150)]
    chain = ["lettering"] * 400 + ["letterinx"] * 40 + ["letterxnx"] * 4
    docs += [(1000, " ".join(chain)), (1000, " ".join(chain)), (None, "alphabet alphabet alphabeta"), (7, None), (8, ""), (9, "a b 12"), (None, "alphabeta")]
    assert told(spark, docs) == variants(docs)


def test_split_buckets(spark):
    """All words in one bucket, in blocks of 16."""
    words = sorted(set(lettered(random.Random(9), 200, "abcd")))
    words = [w for w in words if len(w) >= 7]
    vocab = spark.createDataFrame([(w, 2 + i % 5) for i, w in enumerate(words)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling_variants.near(vocab, bucket=1 << 40, block=16).collect()}
    n = {w: 2 + i % 5 for i, w in enumerate(words)}
    want = {w: [v for v in words if near(w, v)] for w in words}
    assert got == {w: (len(of), n[(b := min(of, key=lambda v: (-n[v], v)))], b) for w, of in want.items() if of}


def test_no_words(spark):
    assert told(spark, [(1, None), (2, "")]) == set()


def negatives(rows, is_anchor, scale, n=5):
    """The contract, anchor by anchor. rows: vec_id, vector, label."""
    sound = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if i not in sound or (label, v) < sound[i]:
            sound[i] = (label, v)
    dims = max((len(v) for _, v in sound.values()), default=0)
    w = {i: np.floor(scale * np.array([*v, *[0.0] * (dims - len(v))])) for i, (_, v) in sound.items()}
    out = set()
    for a in filter(is_anchor, sound):
        scores = sorted((-int(w[a] @ w[i]), i) for i in sound if i != a)
        mine = [(-s, i) for s, i in scores if sound[i][0] == sound[a][0]][:n]
        rest = [(-s, i) for s, i in scores if sound[i][0] != sound[a][0]]
        for p, i in mine:
            for rank, (s, j) in enumerate([(s, j) for s, j in rest if 80 * p <= 100 * s <= 100 * p][:n], 1):
                out.add((a, i, rank, j, p, s))
    return out


def embedded(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({"score": F.lit("x"), "rank": F.lit(0), "b": F.lit(1), "ids": F.lit(1), "query": F.lit(2)})


def clouds(rng, n, dims, spread=0.6, of=7):
    centres = rng.normal(size=(of, dims))
    v = centres[rng.integers(0, of, n)] + spread * rng.normal(size=(n, dims))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


ODD = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")], 1), (903, [float("inf"), 1.0], 2), (904, [0.5], None), (None, [0.5], 1), (905, [], 1), (906, [0.25], 1), (1000, [], 2)]


def test_thresholds_lose_nothing():
    rng = np.random.default_rng(1)
    for t in range(60):
        dims = int(rng.integers(1, 40))
        q = np.floor(rng.normal(size=(rng.integers(1, 20), dims)) * rng.choice([3, 30, 256]) * rng.random(dims) ** 3)
        v = np.floor(rng.normal(size=(rng.integers(1, 900), dims)) * 30)
        exact = q @ v.T
        least = np.quantile(exact, rng.choice([0.0, 0.5, 0.9, 1.0]), axis=1) + rng.integers(-2, 2)
        a, r, s = hard_negatives.above(q, v, least)
        assert sorted(zip(a, r, s, strict=True)) == [(i, j, exact[i, j]) for i, j in np.argwhere(exact >= least[:, None])]


@pytest.mark.parametrize("few", [True, False])
def test_hard_negatives(spark, few, monkeypatch):
    """Near and equal scores, copies, a label with one row, rows that take no part; small blocks, broadcast or not."""
    if not few:
        monkeypatch.setattr(hard_negatives, "MOST_SENT", 0)
    rng = np.random.default_rng(2)
    v = clouds(rng, 400, 12).tolist()
    rows = [(i, v[i % 370] if i < 399 else v[0], int(rng.integers(0, 5)) if i else 77) for i in range(400)] + ODD
    rows += [(5, v[5], rows[5][2]), (5, v[6], 99)]  # a repeated row, and another of its id
    got = hard_negatives.mine(embedded(spark, rows), F.col("vec_id") % 10 == 0, 16, hard_negatives.Mining(rows=64, anchors=16, slab=3)).collect()
    want = negatives(rows, lambda i: i % 10 == 0, 16)
    assert len(got) == len(want) > 500 and {tuple(r) for r in got} == want
    assert hard_negatives.mine(embedded(spark, ODD[:6]), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(embedded(spark, []), F.lit(True)).count() == 0


def neighbours(rows, is_query, k):
    ids = [i for i, _, _ in rows]
    v = np.array([x for _, x, _ in rows], np.float64)
    out = {}
    for i, q in zip(ids, v, strict=True):
        if is_query(i):
            score = (v * q).sum(1)
            out[i] = [(j, s) for s, j in sorted((-s, j) for s, j in zip(score.tolist(), ids, strict=True) if j != i)[:k]]
    return out


def found(spark, rows, how):
    out = {}
    for r in cross_polytope.nearest(embedded(spark, rows), F.col("vec_id") % 20 == 0, how).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], -r["score"]))
    return out


@pytest.mark.parametrize("lengths,cell", [(False, 64), (False, 2), (True, 16)])
def test_nearest_neighbours(spark, lengths, cell):
    """Recall against brute force: unit vectors, cells of two axes, and vectors of different lengths, of which many copies."""
    rng = np.random.default_rng(4)
    v = clouds(rng, 1200, 24)
    if lengths:
        v = v * rng.uniform(0.5, 2, (1200, 1)).astype(np.float32)
    v[600:700] = v[600]
    rows = [(i, x, 0) for i, x in enumerate(v.tolist())]
    got, want = found(spark, rows + rows[:50] + ODD[:6], cross_polytope.Search(cell=cell, rows=100, queries=8)), neighbours(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]
    assert np.mean(hits) >= 0.9
    scores = {i: dict(neighbours(rows, lambda j, i=i: j == i, len(rows))[i]) for i in list(want)[:5]}
    assert all(abs(scores[i][j] - s) < 1e-12 for i in scores for j, s in got[i])


def test_few_vectors(spark):
    """Fewer candidates than neighbours are all returned; ties go to the smaller id; no candidates, no rows."""
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 2.0], 0) for i in range(0, 13)]
    assert found(spark, rows, cross_polytope.Search(target=1.0)) == neighbours(rows, lambda i: i == 0, 20)
    assert found(spark, [(0, [1.0], 0)], cross_polytope.Search()) == found(spark, [], cross_polytope.Search()) == found(spark, [(0, [0.0], 0), (1, [1.0], 0)], cross_polytope.Search()) == {}
