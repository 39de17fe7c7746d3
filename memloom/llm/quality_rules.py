"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Five counts of each text are made in its own row, without a shuffle. Texts that fail the base rules go; of the others, each
(language, source) group gets a minimum-covariance-determinant estimate of five transformed statistics, of half of its rows.
Three starts (medians and MADs; the correlations of squashed statistics; those of their spatial signs) are each
brought to convergence by concentration steps: those keep the half with the smallest Mahalanobis distances and estimate mean
and covariance anew from it. The start that ends with the smallest determinant is kept, and the estimate made once more
from all rows at usual distances. A step is two small aggregations; the distance that the half reaches is
read from a histogram of distances, so that no group meets in a task. A row is rejected if its final distance is beyond
the cutoff.

Each variance gets a floor, for statistics that are the same in nearly all rows of a group. Groups below `least` rows take
the estimate of their language; languages below that have none and reject none.

Defined results: a null text has no words and fails the base rules; a null language or source is a group of its own; repeated
rows get a row each; an empty table gives no rows; input columns named as outputs are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import cut, own, packed, replacing

SPACE = r"\x20\x09-\x0D"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Added to a text's number of words where it decides how many low bits of a window's hash give way to its position; tests raise it.
HASH_BITS_SPARED = 1
#: Groups up to which their estimates are broadcast (some 1.5 kB each); beyond that they are joined by shuffles, which adaptive execution splits.
MOST_SENT = 20_000


@dataclass(frozen=True)
class Rules:
    """Parameters. Cutoff: of squared distance; the 0.999 quantile of chi-squared with 5 degrees, as covariances have their share's consistency factor. Usual: the 0.975 quantile, for the reweighting. Steps: at most, and until no determinant's logarithm falls by 2 * least_gain."""

    share: float = 0.5
    steps: int = 25
    usual: float = 12.833
    cutoff: float = 20.515
    floor: tuple[float, ...] = (0.35, 0.35, 0.06, 0.10, 0.06)
    least: int = 30
    least_gain: float = 1e-3
    bins: int = 32


def chi_squared(x: float, degrees: int) -> float:
    """The distribution function, by its series."""
    a, z = degrees / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if x > 0 else 0.0


def consistency(share: float, d: int) -> float:
    """What a covariance of the share of normal rows that are nearest is too small by."""
    if share >= 1:
        return 1.0
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, d) < share else (low, mid)
    return share / chi_squared(low, d + 2)


def words(text: Column) -> Column:
    found = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(found, lambda w: w != "")


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(w: Column) -> Column:
    """How many places of words lie in windows of three that occur again.

    Hashes of windows are sorted with their positions in the low bits; those next to an equal one may occur again. Of those
    alone the words are sorted, and the places of windows next to one with the same words are united: hashes decide nothing.
    """
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def again(sorted_: Column, same) -> Column:
        return F.filter(sorted_, lambda x, i: F.coalesce(same(x, F.get(sorted_, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_, i + 1)), F.lit(False)))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((x + 3).alias("end"), (acc["total"] + x + 3 - F.greatest(acc["end"], x)).alias("total"))

    def said(i: Column) -> Column:
        return F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))

    def alike(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(high: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        keys = F.sort_array(F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
        near = bound(keys, lambda k: F.transform(again(k, lambda x, y: x.bitwiseAND(high) == y.bitwiseAND(high)), lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int")))
        windows = bound(F.sort_array(F.transform(near, said)), lambda k: F.transform(again(k, alike), lambda x: x["i"]))
        return F.aggregate(F.sort_array(windows), begin, add, lambda acc: acc["total"])

    bits = F.greatest(F.ceil(F.log2(F.size(w) + HASH_BITS_SPARED)), F.lit(1)).cast("int")
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(bound(F.call_function("shiftleft", F.lit(-1).cast("long"), bits), places))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed and _n_lines, the lines with words."""
    base = replacing(docs, *BASE, "base_failed", "kept", "_w", "_lines", "_n_lines")
    base = base.withColumn("_w", words(F.col("text"))).withColumn("_lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    base = base.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "n_repeat_words": bound(F.col("_w"), _repeated).cast("long"),
    }).drop("_w", "_lines")
    return base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")), chars / n, F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]


def factored(estimates: DataFrame, floor: tuple[float, ...], scale: float = 1.0) -> DataFrame:
    """estimates with wij, the inverse of the covariance's Cholesky factor, column by column: squared distance is a sum of squares."""
    d, out = len(floor), estimates
    for i in range(d):
        for j in range(i + 1):
            v = F.col(f"c{j}{i}") * F.lit(scale) + F.lit(floor[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    for i in range(d):
        for j in range(i + 1):
            v = F.lit(float(i == j))
            for k in range(j, i):
                v = v - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", v / F.col(f"l{i}{i}"))
    out = out.withColumn("det", sum(F.log(f"l{i}{i}") for i in range(d)))
    return out.select(*[c for c in out.columns if c[0] not in "lc"])


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. ."""
    total = F.lit(0.0)
    for i in range(d):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + F.pow(z, F.lit(2.0))
    return total


def _middle(rows: DataFrame, keys: list[str], values: list[Column], prefix: str) -> DataFrame:
    """The median of each value in each group, from a histogram with 256 bins a unit."""
    long = rows.select(*keys, F.posexplode(F.array(*values)).alias("i", "x")).groupBy(*keys, "i", F.floor(F.col("x") * 256).alias("bin")).agg(F.count("*").alias("k"))
    each = Window.partitionBy(*keys, "i")
    upto = long.withColumns({"upto": F.sum("k").over(each.orderBy("bin")), "total": F.sum("k").over(each)})
    half = upto.where("2 * upto >= total").groupBy(*keys, "i").agg(((F.min("bin") + 0.5) / 256).alias("v"))
    return half.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"{prefix}{i}") for i in range(len(values))])


def verdicts(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """stats (with lang, source and the base columns) with `kept`."""
    group = [F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("g1"), F.col("lang").isNull().alias("g2"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("g3"), F.col("source").isNull().alias("g4")]
    narrow, d = ["g1", "g2", "g3", "g4"], len(rules.floor)
    keys, xs = [*narrow, "pooled"], [f"x{i}" for i in range(d)]
    every = [*keys, "start"]
    numbered = stats.select(packed(stats, "kept", "_n_lines", name="_stat"), "base_failed", *group, *[x.alias(f"x{i}") for i, x in enumerate(vector())])
    good = numbered.where(~F.col("base_failed")).select(*narrow, *xs)
    counted = cut(good.groupBy(*narrow).agg(F.count("*").alias("own")))
    sent = F.broadcast if counted.limit(MOST_SENT + 1).count() <= MOST_SENT else lambda df: df
    few = counted.where(F.col("own") < rules.least)
    of_language = good.join(sent(few.select("g1", "g2").distinct()), ["g1", "g2"], "left_semi").withColumns({"g3": F.lit(""), "g4": F.lit(False), "pooled": F.lit(True)})
    good = good.join(sent(counted.where(F.col("own") >= rules.least).drop("own")), narrow, "left_semi").withColumn("pooled", F.lit(False)).unionByName(of_language)
    one = (lambda df: df.coalesce(1)) if sent is F.broadcast else lambda df: df  # a table of a row for each group, in one file
    sizes = cut(one(good.groupBy(*keys).agg(F.count("*").alias("all"))))
    pairs = list(combinations_with_replacement(range(d), 2))

    def estimate(rows: DataFrame, by: list[str]) -> DataFrame:
        sums = [F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs]]
        got = rows.groupBy(*by).agg(*sums)
        return got.select(*by, "n", *[f"m{i}" for i in range(d)], *[(F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in pairs])

    medians = cut(_middle(good, keys, [F.col(x) for x in xs], "m"))
    deviations = _middle(good.join(sent(medians), keys), keys, [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(d)], "a")
    robust = cut(medians.join(deviations, keys).select(*keys, *[f"m{i}" for i in range(d)], *[F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), F.lit(2.0)) + rules.floor[i] ** 2).alias(f"a{i}") for i in range(d)]))
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}") for i in range(d)]
    size = F.greatest(F.sqrt(sum(v * v for v in z)), F.lit(1e-9))
    near = good.join(sent(robust), keys)
    bent = near.select(*keys, F.lit(1).alias("start"), *[F.tanh(v).alias(f"x{i}") for i, v in enumerate(z)]).unionByName(near.select(*keys, F.lit(2).alias("start"), *[(v / size).alias(f"x{i}") for i, v in enumerate(z)]))
    of_bent = estimate(bent, every).drop(*[f"m{i}" for i in range(d)]).join(robust, keys)

    def spread(i: int, j: int) -> Column:
        return F.col(f"c{i}{j}") / F.sqrt(F.greatest(F.col(f"c{i}{i}") * F.col(f"c{j}{j}"), F.lit(1e-12))) * F.col(f"a{i}") * F.col(f"a{j}")

    centre = [F.col(f"m{i}") for i in range(d)]
    straight = robust.select(*keys, F.lit(0).alias("start"), F.lit(0).cast("long").alias("n"), *centre, *[(F.pow(f"a{i}", F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs])
    turned = of_bent.select(*every, "n", *centre, *[(F.pow(f"a{i}", F.lit(2.0)) if i == j else spread(i, j)).alias(f"c{i}{j}") for i, j in pairs])
    now = cut(one(factored(straight.unionByName(turned), rules.floor)))
    least = F.greatest(F.ceil(rules.share * F.col("all")), F.floor((F.col("all") + d + 1) / 2))
    for step in range(rules.steps):
        far = good.join(sent(now.drop("n", "det")), keys).withColumn("bin", F.floor(F.log2(_distance(d) + 1e-3) * rules.bins))
        bins = one(far.groupBy(*every, "bin").agg(F.count("*").alias("k")))
        upto = bins.withColumn("upto", F.sum("k").over(Window.partitionBy(*every).orderBy("bin"))).join(sent(sizes), keys)
        edge = upto.where(F.col("upto") >= F.least(least, F.col("all"))).groupBy(*every).agg(F.min("bin").alias("edge"))
        nearest = far.join(sent(edge), every).where(F.col("bin") <= F.col("edge")).select(*every, *xs)
        before, now = now, cut(one(factored(estimate(nearest, every), rules.floor, consistency(rules.share, d))))
        if step and not now.join(before.select(*every, F.col("det").alias("was")), every).where(F.col("det") < F.col("was") - rules.least_gain).head(1):
            break
    names = [c for c in now.columns if c[0] in "mw"]
    best = now.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("b")).select(*keys, "b.*")
    usual = good.join(sent(cut(one(best))), keys).where(_distance(d) <= rules.usual).select(*keys, *xs)
    final = cut(one(factored(estimate(usual, keys), rules.floor, consistency(chi_squared(rules.usual, d), d)))).drop("n", "det").join(sizes, keys)
    small = F.coalesce("own", F.lit(0)) < rules.least
    placed = numbered.join(sent(counted), narrow, "left").withColumns({"pooled": small, "g3": F.when(small, "").otherwise(F.col("g3")), "g4": ~small & F.col("g4")})
    out = placed.join(sent(final), keys, "left").withColumn("_d", _distance(d))
    out = out.withColumn("kept", ~F.col("base_failed") & ((F.coalesce("all", F.lit(0)) < rules.least) | (F.coalesce("_d", F.lit(0.0)) <= rules.cutoff)))
    return out.select("_stat.*", "kept")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs, without their text, with the base counts, base_failed and kept."""
    rows = docs.select(packed(docs, "text", *BASE, "base_failed", "kept"), *[own(docs, c).alias(c) for c in ("lang", "source", "text")])
    return verdicts(cut(statistics(rows).drop("text")), rules).select("_row.*", *BASE, "base_failed", "kept")
