"""Language identification by prediction by partial matching.

For each language, a context tree over bytes, of order ORDER at most, predicts each byte from the longest context that it
holds, with escapes to shorter ones (method C with exclusion: a context that was followed d times by t distinct bytes escapes
with probability t / (d + t), and what is shorter shares that among the bytes that it did not see); below order 0 all 256
bytes are alike. So the probabilities after any context sum to 1. Trees are of variable order: a context is held where it was
seen `least` times, and that rises until a tree has `nodes` nodes at most. The statistics are frozen after training. Code
lengths of all strings of ORDER + 1 bytes that a tree holds are computed once, others when a text has them, both exactly. The
language with the shortest code wins; its score is its share of probability under equal priors.

Bytes are the UTF-8 of the lower-cased text. Trees are built in Spark, a language in a task, and scored in blocks of languages
whose tables take at most BLOCK_BYTES, so any number of languages will do: with more than one block, texts are scored again
for each, with a checkpoint between.

Defined results: a null text and one without a letter are `und` with score 0; ties go to the first language in order of
name; an empty table gives no rows; without training rows all is `und`; input columns named as outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut, held_out, replacing, slices

ORDER = 4
SPAN = ORDER + 1
#: Bytes of a block's tables at most, texts' bytes that are scored at a time.
BLOCK_BYTES, BATCH = 160 << 20, 1 << 18
#: Languages whose shares are broadcast at most; beyond that they are joined by a shuffle.
MOST_SENT = 10_000
UNKNOWN = "und"
#: A string's key: its bytes, and its length above them.
_LENGTH = np.uint64(8 * SPAN)
_GAP = b" " * ORDER


@dataclass(frozen=True)
class Training:
    """Parameters. `sample`: rows of each language at most, on average, chosen by a hash of doc_id; `least`: how often a context was seen; `nodes`: strings of a tree at most."""

    sample: int = 1500
    least: int = 2
    nodes: int = 400_000


def windows(data: np.ndarray) -> np.ndarray:
    """At each place from ORDER on: its byte and the ORDER before it, as a number."""
    n = len(data) - ORDER
    out = data[:n].astype(np.uint64)
    for k in range(1, SPAN):
        out = out << np.uint64(8) | data[k : k + n]
    return out


def _key(strings: np.ndarray, length: int) -> np.ndarray:
    """The key of the last `length` bytes."""
    return strings & np.uint64((1 << 8 * length) - 1) | np.uint64(length) << _LENGTH


@dataclass(frozen=True)
class Tree:
    """A language's strings by key, in order: bits of the last byte after those before it (-1: not seen), and bits to add for an escape from the string as a context. The empty context's escape is `floor`."""

    keys: np.ndarray
    bits: np.ndarray
    escape: np.ndarray
    floor: float

    @classmethod
    def of(cls, strings: np.ndarray, counts: np.ndarray, how: Training = Training()) -> Tree:
        """From the counts of distinct windows."""
        least = how.least
        while (tree := cls._grown(strings, counts, least)) is None or len(tree.keys) > how.nodes:
            least *= 2
        return tree

    @classmethod
    def _grown(cls, strings: np.ndarray, counts: np.ndarray, least: int) -> Tree:
        keys, bits, contexts, escapes = [], [], [], []
        shorter, p_shorter, floor = np.zeros(0, np.uint64), np.zeros(0), 0.0
        for length in range(1, SPAN + 1):
            own, back = np.unique(strings & np.uint64((1 << 8 * length) - 1), return_inverse=True)
            n = np.bincount(back, counts, len(own))
            context, of = np.unique(own >> np.uint64(8), return_inverse=True)
            d, t = np.bincount(of, n, len(context)), np.bincount(of, minlength=len(context))
            if length > 1:
                held = d >= least
                keep = held[of]
                own, n, of = own[keep], n[keep], (np.cumsum(held) - 1)[of[keep]]
                context, d, t = context[held], d[held], t[held]
                below = p_shorter[np.searchsorted(shorter, own & np.uint64((1 << 8 * (length - 1)) - 1))]
            else:
                below = np.full(len(own), 1 / 256)
            full = t == 256
            p = n / np.where(full, d, d + t)[of]
            spare = np.maximum(1 - np.bincount(of, below, len(context)), 1e-12)
            out = np.where(full, 0.0, -np.log2(np.where(full, 1.0, t / (d + t) / spare)))
            if length == 1:
                floor = float(out[0]) if len(out) else 0.0
            else:
                contexts.append(_key(context, length - 1))
                escapes.append(out)
            keys.append(_key(own, length))
            bits.append(-np.log2(p))
            shorter, p_shorter = own, p
        seen, after = np.concatenate(keys), np.concatenate(contexts)
        every = np.unique(np.concatenate([seen, after]))  # what precedes a text is a context only
        out = cls(every, np.full(len(every), -1.0), np.zeros(len(every)), floor)
        out.bits[np.searchsorted(every, seen)] = np.concatenate(bits)
        out.escape[np.searchsorted(every, after)] = np.concatenate(escapes)
        return out


class Index:
    """Places of distinct keys: a table with open addressing, looked up by vectors."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([keys, np.zeros(1, np.uint64)])  # the last stands for "not there"
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, len(keys), np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._at(keys)
        while len(left):
            free = self.table[at] == len(keys)
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, or that after the last."""
        none = len(self.keys) - 1
        at = self._at(keys)
        got = self.table.take(at)
        left = np.flatnonzero((self.keys.take(got) != keys) & (got != none))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            now = self.table.take(at[left])
            got[left] = now
            left = left[(self.keys.take(now) != keys[left]) & (now != none)]
        return got


class Block:
    """The trees of some languages side by side: a row of code lengths for each string."""

    def __init__(self, names: list[str], trees: list[Tree]):
        self.names = names
        self.index = Index(np.unique(np.concatenate([t.keys for t in trees])))
        shape = (len(self.index.keys), len(trees))
        self.bits, self.escape = np.full(shape, -1, np.float32), np.zeros(shape, np.float32)  # -1: not seen
        for k, t in enumerate(trees):
            at = self.index.find(t.keys)
            self.bits[at, k], self.escape[at, k] = t.bits, t.escape
        self.floor = np.array([t.floor for t in trees], np.float32)
        whole = self.index.keys[self.index.keys >> _LENGTH == SPAN] & np.uint64((1 << 8 * SPAN) - 1)
        self.known = Index(whole)
        self.lengths = self.exact(self.known.keys)

    def exact(self, strings: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of windows, by language."""
        out = np.full((len(strings), len(self.names)), 8.0, np.float32)
        escape: np.ndarray = self.floor
        for length in range(1, SPAN + 1):
            seen = self.bits[self.index.find(_key(strings, length))]
            out = np.where(seen >= 0, seen, out + escape)
            escape = self.escape[self.index.find(_key(strings >> np.uint64(8), length))]
        return out

    def measure(self, texts: list[str | None]) -> np.ndarray:
        """Code lengths of texts, by language."""
        out = []
        for data, starts, ends in slices((None if t is None else t.lower() for t in texts), BATCH, _GAP):
            total = np.zeros((len(starts), len(self.names)))
            for i in range(0, len(data) - ORDER, BATCH):
                strings = windows(data[i : i + BATCH + ORDER])
                at = self.known.find(strings)
                each = self.lengths[at]
                new = np.flatnonzero(at == len(self.known.keys) - 1)
                each[new] = self.exact(strings[new])
                run = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(each, axis=0, dtype=np.float64)])
                lo, hi = (np.clip(x - ORDER - i, 0, len(strings)) for x in (starts, ends))
                total += run[hi] - run[lo]
            out.append(total)
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))

    def told(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Of each text: the language with the shortest code, its bits, and all languages' probability as a multiple of that one's."""
        bits = self.measure(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        return [self.names[k] for k in best], least, np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)


@dataclass(frozen=True)
class Model:
    """Blocks of languages, in order of name."""

    blocks: tuple[Block, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for b in self.blocks for n in b.names)

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """The same on the driver."""
        texts = list(texts)
        told = [b.told(texts) for b in self.blocks]
        names, scores = [], []
        for i, t in enumerate(texts):
            if not told or not _has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            name, least, _ = min(((n[i], x[i], m[i]) for n, x, m in told), key=lambda r: (r[1], r[0]))
            names.append(name)
            scores.append(1 / sum(m[i] * 2.0 ** max(-1000, least - x[i]) for _, x, m in told))
        return names, np.array(scores)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def in_blocks(trees: dict[str, Tree], most: int | None = None) -> Model:
    blocks: list[list[str]] = []
    rows = 0
    for name in sorted(trees):
        rows += len(trees[name].keys)
        if not blocks or rows * (40 + 12 * (len(blocks[-1]) + 1)) > (most or BLOCK_BYTES):
            blocks.append([])
            rows = len(trees[name].keys)
        blocks[-1].append(name)
    return Model(tuple(Block(names, [trees[n] for n in names]) for names in blocks))


def counts(picked: DataFrame) -> DataFrame:
    """lang, string and n: how often each window occurs in the texts of picked (lang, text)."""

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, part in f.groupby("lang"):
                for data, starts, ends in slices((t.lower() for t in part["text"]), 1 << 20, _GAP):
                    found = windows(data)
                    inside = np.zeros(len(found) + 1, np.int64)
                    np.add.at(inside, starts - ORDER, 1)
                    np.add.at(inside, ends - ORDER, -1)
                    got, n = np.unique(found[np.cumsum(inside)[:-1] > 0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "string": got.astype(np.int64), "n": n})

    each = picked.select("lang", "text").mapInPandas(grams, "lang string, string long, n long")
    return each.groupBy("lang", "string").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, how: Training = Training()) -> Model:
    """A model from text and non-null lang of rows that aren't held out. A task gets one language's counts, the driver its tree."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = known.groupBy("lang").agg((F.lit(float(how.sample)) / F.count("*")).alias("share"))
    few = share.limit(MOST_SENT + 1).count() <= MOST_SENT
    picked = known.join(F.broadcast(share) if few else share, "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def build(f: pd.DataFrame) -> pd.DataFrame:
        order = f.sort_values("string")
        t = Tree.of(order["string"].to_numpy(np.uint64), order["n"].to_numpy(np.float64), how)
        return pd.DataFrame({"lang": [f["lang"].iloc[0]], "keys": [t.keys.tobytes()], "bits": [t.bits.astype(np.float32).tobytes()], "escape": [t.escape.astype(np.float32).tobytes()], "floor": [t.floor]})

    rows = counts(picked).groupBy("lang").applyInPandas(build, "lang string, keys binary, bits binary, escape binary, floor double").collect()
    return in_blocks({r["lang"]: Tree(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["bits"], np.float32), np.frombuffer(r["escape"], np.float32), r["floor"]) for r in rows})


def _measuring(held):
    @F.pandas_udf("name string, bits double, mass double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        lettered = np.array([_has_letter(t) for t in texts], bool)
        names, least, mass = held.value.told([t if ok else None for t, ok in zip(texts, lettered, strict=True)])
        return pd.DataFrame({"name": np.where(lettered, names, UNKNOWN), "bits": least, "mass": np.where(lettered, mass, np.inf)})

    return measured


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `lang_pred` and `score` (0 to 1)."""
    out = replacing(docs, "lang_pred", "score")
    told = _name(out)
    for k, block in enumerate(model.blocks):
        now = _measuring(docs.sparkSession.sparkContext.broadcast(block))("text")
        if not k:
            out = out.withColumn(told, now)
            continue
        out = cut(out).withColumn(told + "2", now)
        a, b = F.col(told), F.col(told + "2")
        first = (a["bits"] < b["bits"]) | ((a["bits"] == b["bits"]) & (a["name"] <= b["name"]))
        least = F.least(a["bits"], b["bits"])
        mass = a["mass"] * F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), least - a["bits"])) + b["mass"] * F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), least - b["bits"]))
        out = out.withColumn(told, F.struct(F.when(first, a["name"]).otherwise(b["name"]).alias("name"), least.alias("bits"), mass.alias("mass"))).drop(told + "2")
    if not model.blocks:
        return out.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    return out.withColumns({"lang_pred": F.col(told)["name"], "score": 1 / F.col(told)["mass"]}).drop(told)


def _name(df: DataFrame) -> str:
    """A column name that df hasn't got."""
    name = "_told"
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name
