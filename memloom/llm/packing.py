"""Best-fit packing of tokenized documents by exact-complement hashing.

Documents become pieces of at most `capacity` ids. The plan is made from the histogram of lengths alone, which has at most
`capacity` rows at any size of input: from the longest length on, an index of the sums of one, two and three available
lengths gives combinations that fill the gap exactly, each used as often as its counts allow; what is left goes best fit,
longest first. A plan is a list of patterns with counts, a few for each length. Pieces get their places from their rank
among those of their length; ranks come from counts by (partition, length) and a running total, so that neither a common
length nor all pieces meet in one task.

Defined results: a null text is empty and has the end id alone; repeated rows are packed each; a null doc_id is kept; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm import tokens
from memloom.llm.common import cut

CAPACITY = 4096


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, kept_words: int = tokens.KEPT_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit)."""
    import pyarrow as pa

    path = tokenizer or tokens.default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut_up(batches):
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tokens.encoder(path, kept_words).encode(b.column("text")), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                    held += len(part) * with_ids
                if held > 1 << 24:
                    yield as_batch(rows, b)
                    rows, held = [], 0
            yield as_batch(rows, b)

    def as_batch(rows, like):
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [like.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 5 + with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names[:n])

    return docs.select("doc_id", "text").mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[((length, how many), ...), sequences of that kind] for so many pieces of each length."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    left: dict[int, int] = {}
    if have[capacity]:
        out.append((((capacity, 1),), int(have[capacity])))
        have[capacity] = 0
    sums_of_two = _pair_sums(have)

    def enough(parts: tuple[int, ...]) -> int:
        return min(int(have[x]) // k for x, k in Counter(parts).items())

    def pair(gap: int, first: tuple[int, ...], most: int) -> tuple[int, ...] | None:
        """Two lengths with this sum, neither above most, the longer as long as can be."""
        b = np.arange(max(1, gap - most), gap // 2 + 1)
        for x in b[(have[b] > 0) & (have[gap - b] > 0)]:
            if enough(parts := (*first, gap - int(x), int(x))):
                return parts
        return None

    for a in range(capacity - 1, 0, -1):
        while have[a]:
            gap, parts = capacity - a, None
            if gap <= a and enough((a, gap)):
                parts = (a, gap)
            if not parts and sums_of_two[gap]:
                parts = pair(gap, (a,), a)
                if not parts:
                    sums_of_two = _pair_sums(have)
            if not parts:
                c = np.flatnonzero(have[: min(a, gap - 2) + 1])[::-1] if gap > 2 else []
                for x in c:
                    if sums_of_two[gap - x] and (parts := pair(gap - int(x), (a, int(x)), int(x))):
                        break
            if not parts:
                left[a] = int(have[a])
                have[a] = 0
                sums_of_two = sums_of_two if len(left) % 16 else _pair_sums(have)
                break
            n = enough(parts)
            used = Counter(parts)
            for x, k in used.items():
                have[x] -= n * k
            out.append((tuple(sorted(used.items(), reverse=True)), n))
    return out + _best_fit(left, capacity)


def _pair_sums(have: np.ndarray) -> np.ndarray:
    there = (have > 0).astype(np.float32)
    size = 1 << (2 * len(have) - 1).bit_length()
    f = np.fft.rfft(there, size)
    return np.fft.irfft(f * f, size)[: len(have)] > 0.5


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    open_at: dict[int, list[tuple[Counter, int]]] = {}
    full = np.zeros(capacity + 1, bool)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = np.flatnonzero(full[length:])
            if len(at):
                gap = length + int(at[0])
                kind, k = open_at[gap].pop()
                each = min(gap // length, n)
                used = min(k, n // each)
                if used < k:
                    open_at[gap].append((kind, k - used))
                full[gap] = bool(open_at[gap])
            else:
                gap, kind = capacity, Counter()
                each = min(capacity // length, n)
                used = n // each
            open_at.setdefault(gap - each * length, []).append((kind + Counter({length: each}), used))
            full[gap - each * length] = True
            n -= used * each
    return [(tuple(sorted(kind.items(), reverse=True)), k) for some in open_at.values() for kind, k in some]


def places(patterns) -> dict[str, np.ndarray]:
    """Sorted by (length, first rank): sequence, pieces a sequence, and offset of the pieces from that rank on."""
    seen: Counter = Counter()
    rows, sequence = [], 0
    for kinds, n in patterns:
        offset = 0
        for length, k in kinds:
            rows.append(((length << 40) | seen[length], sequence, k, offset))
            seen[length] += n * k
            offset += length * k
        sequence += n
    rows.sort()
    return dict(zip(("key", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, kept_words: int = tokens.KEPT_WORDS) -> DataFrame:
    """The pieces with sequence_id and offset; sequences() makes texts of ids of them. kept_words: words whose ids a worker keeps, some 200 bytes each."""
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer, capacity, with_ids, kept_words)).withColumn("part", F.spark_partition_id())
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = cut(counts)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    made = places(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    held = spark.sparkContext.broadcast(made)  # a few rows for each of `capacity` lengths

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = held.value
        key = (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64)
        i = np.searchsorted(p["key"], key, "right") - 1
        nth = key - p["key"][i]
        return pd.DataFrame({"sequence_id": p["sequence"][i] + nth // p["each"][i], "offset": p["offset"][i] + nth % p["each"][i] * length})

    local = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = found.withColumn("rank", local).join(before, ["part", "length"])
    out = ranked.withColumn("placed", placed("length", F.col("rank") + F.col("before")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "placed.sequence_id", "placed.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (little-endian unsigned 32-bit) of each sequence, from pieces packed with their ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))
