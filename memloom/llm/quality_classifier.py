"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax over two classes
follows. The vectors are trained by numpy stochastic gradient descent, one document at a time, on a bounded sample of
labelled rows. As a softmax of an average of vectors is an average of each vector's logit, a trained model is folded
into one number for each bucket, and scoring is a lookup and a sum for each n-gram: exact, and linear in the text.

Defined results: a null text scores as an empty one; an empty text scores by the bias alone; repeated rows score alike;
an empty table gives no rows; without usable labels every score is 0.5; input columns named as outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import own, replacing, sampled, slices, sums

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (3, 4)
#: After the buckets: a word equal to the one before it.
SAME_WORD, SIZE = BUCKETS, BUCKETS + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


@dataclass(frozen=True)
class Training:
    """Parameters. `sample`: labelled rows at most, the first by a hash of doc_id, half of them from either label where there are so many, of `most_bytes` at most together."""

    sample: int = 4000
    most_bytes: int = 64 << 20
    dims: int = 16
    epochs: int = 4
    rate: float = 60.0
    l2: float = 1e-6
    seed: int = 7


def features(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of words, of each order of n-grams, and of repeated words."""
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    out = []
    if len(starts):
        place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
        part = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _POW[place & 63], np.uint64(0))
        words = np.add.reduceat(part, starts)
        mixed = words * np.uint64(0xD6E8FEB86659FD93)
        out.append((starts, (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)))
        same = starts[1:][words[1:] == words[:-1]]
        out.append((same, np.full(len(same), SAME_WORD)))
    code = data.astype(np.uint32)
    for n in NGRAMS:
        gram = code[: len(code) - n + 1].copy()
        for k in range(1, n):
            gram = (gram << np.uint32(8)) | code[k : len(code) - n + 1 + k]
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        out.append((np.arange(len(gram)), (gram >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)))
    return out


def _tallied(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text, ascending, and how often each comes."""
    for data, starts, ends in slices(texts):
        found = features(data)
        for a, b in zip(starts, ends, strict=True):
            ids = [buckets[slice(*np.searchsorted(at, (a, b)))] for at, buckets in found]
            ids, n = np.unique(np.concatenate(ids) if ids else np.zeros(0, int), return_counts=True)
            yield ids.astype(np.int32), n


def _shares(n: np.ndarray) -> np.ndarray:
    return (n / max(1, n.sum())).astype(np.float32)


def counted(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text, and the share of each."""
    for ids, n in _tallied(texts):
        yield ids, _shares(n)


def packed(texts: Iterable[str | None]) -> Iterator[bytes]:
    """Each text's buckets and counts in little room: the gaps between buckets, then the counts, each split by significance of bytes and deflated."""
    for ids, n in _tallied(texts):
        yield zlib.compress(np.concatenate([np.diff(ids, prepend=0), n]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


@dataclass(frozen=True)
class Rows(Sequence):
    """(buckets, shares, label) of labelled documents, each unpacked only while it is looked at."""

    rows: list[tuple[bytes, int]]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        raw, y = self.rows[i]
        gaps, n = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(2, -1)
        return np.cumsum(gaps, dtype=np.int32), _shares(n.astype(np.int64)), y


@dataclass(frozen=True)
class Model:
    """logit[bucket]: what a feature adds to the log odds of label 1, before averaging."""

    logit: np.ndarray
    bias: float

    def score(self, texts) -> np.ndarray:
        out = []
        for data, starts, ends in slices(texts):
            total, n = np.zeros(len(starts)), np.zeros(len(starts))
            for at, buckets in features(data):
                lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
                total += sums(self.logit[buckets], lo, hi)
                n += hi - lo
            out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def learned(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], how: Training = Training()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SGD over (buckets, shares, label) of each labelled document: a vector for each bucket, the output's weights, its biases."""
    rng = np.random.default_rng(how.seed)
    table = (rng.standard_normal((SIZE, how.dims)) * 0.1).astype(np.float32)
    out = (rng.standard_normal((how.dims, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = how.epochs * len(rows), 0
    for _ in range(how.epochs):
        for i in rng.permutation(len(rows)):
            ids, share, y = rows[i]
            rate = 1 - done / steps
            done += 1
            x = share @ table[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= 0.2 * rate * np.outer(x, p)
            bias -= 0.02 * rate * p
            table[ids] -= how.rate * rate * (share[:, None] * back + how.l2 * table[ids])
    return table, out, bias


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], how: Training = Training()) -> Model:
    """What was learned, folded into a logit for each bucket; scores 0.5 where only one label is known."""
    if len({y for *_, y in rows}) < 2:
        return Model(np.zeros(SIZE, np.float32), 0.0)
    table, out, bias = learned(rows, how)
    side = out[:, 1] - out[:, 0]
    return Model((table @ side).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """A model from the labelled rows of docs that aren't held out.

    The driver gets the sampled rows' bucket counts, packed, never texts: at most `sample` rows, of `most_bytes` of text at most.
    """
    picked = sampled(docs.withColumn("text", F.coalesce(own(docs, "text"), F.lit(""))), labels, "quality", {0: how.sample // 2, 1: how.sample // 2}, how.most_bytes)

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            got = pa.array(packed(b.column("text").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), got], ["doc_id", "y", "packed"])

    rows = picked.select("doc_id", "text", "y").mapInArrow(pack, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, packed binary").collect()
    return fit(Rows([(raw, y) for _, raw, y in sorted((r["doc_id"], bytes(r["packed"]), r["y"]) for r in rows)]), how)


def probability(docs: DataFrame, model: Model) -> Column:
    """The probability of label 1 (0 to 1) of docs' texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts))

    return scored(own(docs, "text"))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= threshold, else 0)."""
    out = replacing(docs, "score", "predicted")
    out = out.withColumn("score", probability(out, model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least the threshold, with their own columns only."""
    return docs.where(probability(docs, model) >= threshold)
