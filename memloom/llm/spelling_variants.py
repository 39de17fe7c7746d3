"""Spelling variants: words of a corpus that are one letter from a much commoner word.

The vocabulary is counted on Spark. Near words (one letter inserted, deleted or replaced) share their first or their last
half: of two words whose shorter has m letters, the first m // 2 or the last m // 2 letters agree. Each word goes to
buckets by its halves, and in a bucket a bit-sliced index has, for each position and letter, the set of the words with that
letter there, a bit a word. For all words of the bucket at once, recurrences over the letters keep the sets of words reached
without an error and with one replaced, inserted (positions shifted right) or deleted letter (shifted left). Words of any
length are read to their end; sets that are empty end a bucket early. A bucket of many words is split in blocks, and each
pair of blocks is a task of its own.

Nulls and empties: a null text has no words, a null doc_id is an empty string before the colon. Repeated rows count as often
as they are there. An empty table, or one without words, gives no rows. Other columns of the documents are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut, own

#: Letters: A-Z, a-z, and U+00C0 to U+00FF, so that a word has a byte for each letter in Latin-1.
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Shortest word; least occurrences; how much commoner a form must be.
SHORTEST, LEAST, RATIO = 7, 2, 10

#: Words that a bucket has on average, and at most before it is split.
BUCKET, BLOCK = 1024, 2048


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id and run: the maximal runs of `shortest` letters or more in text, A-Z lower-cased, one row for each."""
    found = docs.select(own(docs, "doc_id").alias("doc_id"), F.explode(F.regexp_extract_all(own(docs, "text"), F.lit(LETTER + "{%d,}" % shortest), F.lit(0))).alias("run"))
    return found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def slipped(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run as it is, or without one letter where `every` divides the crc32 of `<doc_id>:<run>`: reproducible slips."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: the words of `shortest` letters or more that occur `least` times or more."""
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def near(vocab: DataFrame, shortest: int = SHORTEST, bucket: int = BLOCK // 2, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best: how many near words each has, and the commonest of them (of alike ones the first). vocab: word, n, distinct words."""
    size = F.length("word")
    shorter = F.array(size, size - 1)
    each = vocab.select("word", "n", F.explode(F.filter(shorter, lambda m: m >= shortest)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).cast("byte").alias("side"), F.substring("word", F.lit(1), half).alias("key")), F.struct(F.lit(1).cast("byte").alias("side"), F.substring("word", F.length("word") - half + 1, half).alias("key")))
    each = each.select("word", "n", "m", F.explode(sides).alias("_s")).select("word", "n", "m", "_s.side", F.xxhash64("m", "_s.side", "_s.key").alias("_h"))
    words = vocab.count()
    entries = each.withColumn("bucket", F.pmod("_h", F.lit(max(1, -(-4 * words // bucket))))).drop("_h")
    blocks = entries.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = entries.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other")}).select("bucket", "a", "b", (F.col("mine") == F.col("b")).alias("asks"), "word", "n", "m", "side")
    found = dealt.groupBy("bucket", "a", "b").applyInPandas(_of_bucket, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.less")).alias("best_n"), "_b.best")


def _of_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The near words among a bucket's blocks a and b: all pairs of one block, or each of b with each of a; both ways."""
    same = key[1] == key[2]
    asks = rows if same else rows[rows["asks"]]
    held = rows if same else rows[~rows["asks"]]
    if not len(asks) or not len(held):
        return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []})
    asks, held = (x.iloc[np.argsort(-x["word"].str.len().to_numpy(), kind="stable")].reset_index(drop=True) for x in (asks, held))
    q, v = near_pairs(asks["word"].tolist(), held["word"].tolist())
    # a pair counts where both came by the same half of the shorter word: by the last only if the first differs
    m, side = asks["m"].to_numpy()[q], asks["side"].to_numpy()[q]
    fits = (m == held["m"].to_numpy()[v]) & (side == held["side"].to_numpy()[v])
    q, v, m, side = q[fits], v[fits], m[fits], side[fits]
    said, known = asks["word"].tolist(), held["word"].tolist()
    keep = []
    for a, b, k, s in zip(q, v, m, side, strict=True):
        x, y, h = said[a], known[b], k // 2
        first = x[:h] == y[:h]
        keep.append(min(len(x), len(y)) == k and (first if s == 0 else not first and x[-h:] == y[-h:]))
    q, v = q[np.array(keep, bool)], v[np.array(keep, bool)]
    n, their = asks["n"].to_numpy(), held["n"].to_numpy()
    best: dict[str, list] = {}  # word: near words, what orders the best of them, the best
    for i, j in zip(q, v, strict=True):
        for word, of, size in ((said[i], known[j], their[j]), (known[j], said[i], n[i]))[: 1 if same else 2]:
            was = best.setdefault(word, [0, (-size, of)])
            was[0] += 1
            was[1] = min(was[1], (-size, of))
    return pd.DataFrame({"word": pd.Series(list(best), dtype=object), "n_near": [x[0] for x in best.values()], "best_n": [-x[1][0] for x in best.values()], "best": pd.Series([x[1][1] for x in best.values()], dtype=object)})


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.cumsum(sizes) - sizes, sizes


def near_pairs(asks: list[str], held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (of asks, of held) of the pairs that differ by exactly one inserted, deleted or replaced letter. Both lists are by falling length."""
    flat, start, size = _letters(asks)
    there, at, long = _letters(held)
    wide = -(-len(held) // 64)
    letters, code = np.unique(there), np.full(256, -1, np.int16)
    code[letters] = np.arange(len(letters))

    def slice_of(p: int) -> np.ndarray:
        """For each letter, and last for any other, the set of the held words with it at position p."""
        out = np.zeros((len(letters) + 1, wide * 64), bool)
        n = int(np.searchsorted(-long, -p, "left"))  # words longer than p
        if p >= 0 and n:
            out[code[there[at[:n] + p]], np.arange(n)] = True
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def with_size(x: np.ndarray) -> np.ndarray:
        return np.packbits(np.pad(long[None, :] == x[:, None], ((0, 0), (0, wide * 64 - len(held)))), axis=1, bitorder="little").view(np.uint64)

    every = np.packbits(np.arange(wide * 64) < len(held), bitorder="little").view(np.uint64)
    exact = np.repeat(every[None, :], len(asks), 0)  # no error so far
    swapped, added, missing = (np.zeros_like(exact) for _ in range(3))  # one letter replaced; one more in the held word; one less
    pairs_q, pairs_v = [], []
    before, here, after = slice_of(-1), slice_of(0), slice_of(1)
    for p in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -p, "left"))  # asking words longer than p
        c = code[flat[start[:n] + p]]
        e, s, i, d = exact[:n], swapped[:n], added[:n], missing[:n]
        hit = here[c]
        d &= before[c]
        d |= e
        s &= hit
        s |= e & ~hit
        i |= e
        i &= after[c]
        e &= hit
        done = int(np.searchsorted(-size, -p - 1, "left"))  # of these, longer than p + 1: the others end here
        if done < n:
            last = slice(done, n)
            of = size[last]
            ended = (swapped[last] & with_size(of)) | ((added[last] | exact[last]) & with_size(of + 1)) | (missing[last] & with_size(of - 1))
            some = np.flatnonzero(ended.any(1))
            if len(some):
                q, v = np.nonzero(np.unpackbits(ended[some].view(np.uint8), axis=1, bitorder="little"))
                pairs_q.append(done + some[q])
                pairs_v.append(v)
        if p >= 31 and not p & (p + 1) and not any(x[:done].any() for x in (swapped, added, missing)) and not _others(exact[:done], asks, held):
            break
        before, here, after = here, after, slice_of(p + 2)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(pairs_q), np.concatenate(pairs_v)) if pairs_q else (empty, empty)


def _others(exact: np.ndarray, asks: list[str], held: list[str]) -> bool:
    """Whether some word still agrees without an error with a word that isn't the same."""
    for k in np.flatnonzero(exact.any(1)):
        bits = np.flatnonzero(np.unpackbits(exact[k].view(np.uint8), bitorder="little"))
        if any(held[b] != asks[k] for b in bits):
            return True
    return False


def forms(vocab: DataFrame, ratio: int = RATIO, shortest: int = SHORTEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of vocab (word, n).

    form: the commonest near word (of alike ones the first by code points) if it is `ratio` times as common or more; root:
    where forms lead in the end, the word itself without one. Chains double with each join, so few are enough.
    """
    vocab = cut(vocab)
    found = near(vocab, shortest)
    much = F.col("best_n") >= ratio * F.col("n")
    own_form = vocab.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best")).alias("form"), F.when(much, F.col("best_n")).alias("form_n"))
    own_form = cut(own_form)
    links = own_form.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if onward.join(links, "root", "left_semi").isEmpty():
            break
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    out = own_form.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
