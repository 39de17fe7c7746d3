"""License scans by sparse TF-IDF cosine and inheritance by path joins, in DataFrame operations only.

Three kinds of units of each file are compared with templates: its lines, its header blocks (runs of up to RUN adjoining
paragraphs, which end at lines without a word and where comments begin or end) and the file as a whole. One-line TEMPLATES
are compared with lines; the forms of `license_forms` (titles, notices, identifiers, full texts) with all three, by their
distinct words, as long texts would be weighed by their commonest words otherwise. Copyright statements count as none of
a unit's words. A file's own license is that of the best unit at or above the threshold: long forms (LONG words) go before
short ones, and "all rights reserved" is what is left without a named license.

Units that can't reach the threshold are left out beforehand, by bounds that lose none: for one-line templates, a unit whose
words have too small a share of the template's vector; for forms, a unit without any of the form's anchors, chosen so that its
other words have too small a share of its vector, and one with too few words that any form has (for full texts of BOOK words
and more, that alone).

A file whose name is that of a license file speaks for its directory, and a
file without a license of its own takes that of the nearest ancestor directory that has one: file paths are exploded
into their ancestors and joined with the directories.

Defined results: a null text has no lines; a null path has no directory and no result of its own; ties between templates go
to the first in order of name, ties between license files of a directory to the higher score, then the first path; files of
one path with different texts are told apart, and rows repeated whole get a row each; an empty table gives no rows; only path
and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut
from memloom.llm.license_forms import forms
from memloom.llm.quality_rules import bound

#: What single lines of common licenses say.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|copyright|notice)[^/]*$"
THRESHOLD = 0.75
#: Paragraphs of a header block at most; words of a form that counts as long, and of one that is sought in whole files by how many words there are of it.
RUN, LONG, BOOK = 8, 25, 130
#: Directories up to which what they inherit is broadcast (some 200 bytes each); beyond that it is joined by a shuffle.
MOST_SENT = 50_000
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words that any English text has: anchors are of other words, where there are enough of those.
_COMMON = frozenset(
    "a all also an and any are as at be because been but by can do each even every for free from had has have her his how if in into is it its like made make may more most must not of on one only "
    "or other our out over own same see should so some such than that the their them then there these they this those through to under up upon use used using very was we were what when where which "
    "who will with within without would you your".split()
)
_LEGAL = re.compile(r"licen|copyright|redistribut|warrant|rights|gpl|spdx|merchantab|sublicens|reserved")
#: A copyright statement, to the end of its line or to "all rights reserved".
_STATEMENT = r"(?:copyright[ \t]+(?:\(c\)|\x{A9}|(?=[0-9]{4}))|\(c\)[ \t]+copyright|\x{A9}[ \t]*(?=[0-9]{4}))[^\n]*?(?=all rights reserved|\n|$)"
_COMMENT = r"[ \t]*(?://|#|--|;|%)"


def weights(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, str, float, float]]:
    """(template, word, its share of the template's unit vector, idf) from the templates alone; they're a fixed few."""
    counted = {name: Counter(re.findall(_WORD, text.lower())) for name, text in templates.items()}
    df = Counter(w for c in counted.values() for w in c)
    idf = {w: 1 + math.log((1 + len(counted)) / (1 + n)) for w, n in df.items()}
    out = []
    for name, c in counted.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        out += [(name, w, n * idf[w] / norm, idf[w]) for w, n in c.items()]
    return out


def form_weights(known: tuple[tuple[str, str], ...]) -> list[tuple[str, int, bool, str, float, float]]:
    """(license, form, whether it's long, word, its share of the form's unit vector, idf); each distinct word counts once."""
    held = [(name, set(re.findall(_WORD, re.sub(_STATEMENT.replace(r"\x{A9}", "\xa9"), " ", text.lower(), flags=re.M)))) for name, text in known]
    df = Counter(w for _, ws in held for w in ws)
    idf = {w: 1 + math.log((1 + len(held)) / (1 + n)) for w, n in df.items()}
    norms = [math.sqrt(sum(idf[w] ** 2 for w in ws)) for _, ws in held]
    return [(name, k, len(ws) >= LONG, w, idf[w] / norms[k], idf[w]) for k, (name, ws) in enumerate(held) for w in sorted(ws)]


def _first(shares: dict[str, float]):
    """Orders words by how well they tell licenses from other text."""
    return lambda w: (w in _COMMON, not _LEGAL.search(w), len(w) < 4, -round(shares[w], 9), -len(w), w)


def anchors(shares: dict[str, float], threshold: float) -> set[str]:
    """Words of a form of which a unit that is like it has one: without them, too few of its words or too small a share of its vector is left.

    A unit must have the threshold's share of a short form's words, so that a rare word alone doesn't make a title.
    """
    left, out = 1.0, set()
    spare = len(shares) - least(len(shares), threshold)
    for w in sorted(shares, key=_first(shares)):
        if left < threshold**2 - 1e-9 or len(out) > spare:
            break
        out.add(w)
        left -= shares[w] ** 2
    return out


def reaches(found: Column, templates: dict[str, dict[str, float]], threshold: float) -> Column:
    """Whether a unit with these words may reach the threshold of a template: its cosine is at most the length of the template's vector over the words that it has."""
    out = F.lit(False)
    for shares in templates.values():
        has = [F.when(F.array_contains(found, w), F.lit(s * s)).otherwise(0.0) for w, s in shares.items()]
        out = out | (sum(has[1:], has[0]) >= threshold**2 - 1e-9)
    return out


def least(size: int, threshold: float) -> int:
    """How many of its words a unit must have to be like a form of so many."""
    return math.ceil((threshold if size < LONG else threshold**2) * size - 1e-9)


def _literal(words) -> Column:
    return F.split(F.lit(" ".join(sorted(words))), " ")


def _words(said: Column) -> Column:
    return F.regexp_extract_all(said, F.lit(f"({_WORD})"), F.lit(1))


def units(files: DataFrame, short: list, long: list, threshold: float) -> DataFrame:
    """path, mark (a hash of the text), unit, kind and said (lower case) of the units that may reach the threshold."""
    ones: dict[str, dict[str, float]] = {}
    for name, w, share, _ in short:
        ones.setdefault(name, {})[w] = share
    shares: dict[int, dict[str, float]] = {}
    for _, k, _, w, share, _ in long:
        shares.setdefault(k, {})[w] = share
    small = [v for v in shares.values() if len(v) < BOOK]
    book = min((least(len(v), threshold) for v in shares.values() if len(v) >= BOOK), default=1 << 30)
    of_lines = _literal({w for v in ones.values() for w in v})
    of_forms = _literal(set().union(*(anchors(v, threshold) for v in small)))
    known = _literal({w for _, _, _, w, _, _ in long})
    distinct = lambda said: F.array_distinct(_words(said))
    marked = lambda said, marks: F.arrays_overlap(distinct(said), marks)
    low = files.select("path", F.xxhash64("text").alias("mark"), F.lower("text").alias("_low")).where("path IS NOT NULL AND text IS NOT NULL").withColumn("_distinct", distinct(F.col("_low")))
    matched = F.size(F.array_intersect("_distinct", known))
    whole = (F.size("_distinct") >= book) & (matched >= book) & (matched >= threshold**2 * F.size("_distinct") - 1e-6)
    low = low.withColumns({"_book": whole, "_small": F.arrays_overlap("_distinct", of_forms), "_raw": bound(F.array_intersect("_distinct", of_lines), lambda w: reaches(w, ones, threshold))})
    low = low.where("_book OR _small OR _raw").withColumn("_plain", F.regexp_replace("_low", _STATEMENT, " "))
    fenced = F.regexp_replace(F.regexp_replace("_plain", rf"(?m)^({_COMMENT}[^\n]*)\n(?!{_COMMENT})", "$1\n\n"), rf"(?m)^(?!{_COMMENT})([^\n]*)\n(?={_COMMENT})", "$1\n\n")
    parts = F.when(F.col("_small"), F.split(fenced, r"\n[^a-z0-9]*\n")).otherwise(F.array().cast("array<string>"))
    begins = F.transform("_parts", lambda p: marked(p, of_forms))
    runs = F.flatten(F.transform(F.filter(F.transform("_begins", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size("_parts") - i)), lambda n: F.array_join(F.slice("_parts", i + 1, n), "\n"))))
    lines = lambda said, on, passes: F.when(F.col(on), F.filter(F.split(said, "\n"), passes)).otherwise(F.array().cast("array<string>"))
    like_line = lambda x: bound(F.array_intersect(_words(x), of_lines), lambda w: reaches(w, ones, threshold))
    split = low.withColumn("_parts", parts).withColumn("_begins", begins)
    split = split.select("path", "mark", lines("_low", "_raw", like_line).alias("_lines"), F.array_distinct(F.concat(F.array("_plain"), runs, lines("_plain", "_small", lambda x: marked(x, of_forms)))).alias("_larger"))
    told = lambda said, kind: F.transform(said, lambda x: F.struct(x.alias("said"), F.lit(kind).alias("kind")))
    each = split.select("path", "mark", F.explode(F.concat(told("_lines", "raw"), told("_larger", "form"))).alias("u")).select("path", "mark", "u.said", "u.kind")
    words = distinct(F.col("said"))
    enough = F.size(F.array_intersect(words, known)) >= threshold**2 * F.size(words) - 1e-6
    return each.where((F.col("kind") == "raw") | enough).withColumn("unit", F.monotonically_increasing_id())


def headers(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """path, mark, own_license and own_score of the files with a unit like a template. A word that no template has weighs as one that a single template has."""
    known = forms() if known is None else known
    spark, short, long = files.sparkSession, weights(templates), form_weights(known)
    found = cut(units(files, short, long, threshold))
    each = found.select("path", "mark", "unit", "kind", F.explode(_words(F.col("said"))).alias("word")).groupBy("path", "mark", "unit", "kind", "word").agg(F.count("*").alias("n"))

    def scores(counts: DataFrame, t: DataFrame, n: int) -> DataFrame:
        idf = t.groupBy("word").agg(F.max("idf").alias("idf"))
        weighed = counts.join(F.broadcast(idf), "word", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(1 + math.log((1 + n) / 2))))
        norms = weighed.groupBy("path", "mark", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        dots = weighed.join(F.broadcast(t.drop("idf")), "word").groupBy("path", "mark", "unit", "license", "form", "long", "least").agg(F.sum(F.col("x") * F.col("share")).alias("dot"), F.count("*").alias("hits"))
        return dots.where("hits >= least").join(norms, ["path", "mark", "unit"]).select("path", "mark", "license", "long", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)

    schema = "license string, form int, long boolean, word string, share double, idf double, least int"
    sizes = Counter(row[1] for row in long)
    one = spark.createDataFrame([(name, 0, False, w, share, idf, 1) for name, w, share, idf in short], schema)
    cosine = scores(each.where("kind = 'raw'"), one, len(templates))
    if known:
        cosine = cosine.unionByName(scores(each.where("kind = 'form'").withColumn("n", F.lit(1)), spark.createDataFrame([(*row, least(sizes[row[1]], threshold)) for row in long], schema), len(known)))
    order = F.struct(~F.col("long"), F.col("license") == "Proprietary", -F.col("score"), "license")
    best = cosine.groupBy("path", "mark").agg(F.min_by(F.struct("license", "score"), order).alias("b"))
    return best.select("path", "mark", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"))


def directory(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The directories of a path, nearest first: a/b/c gives a/b, a and the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files' path with license, score, origin (own, inherited or none) and from_path (the directory it is inherited from, empty for the root).

    Files without a license are joined by directory, not one by one: a directory has one row however many files lie in it.
    """
    own = cut(headers(files, templates, threshold))
    speaking = own.where(F.col("path").rlike(LICENSE_FILE)).select(directory(F.col("path")).alias("dir"), "path", "own_license", "own_score")
    dirs = speaking.groupBy("dir").agg(F.min_by(F.struct("own_license", "own_score"), F.struct(-F.col("own_score"), "path", "own_license")).alias("d"))
    paths = files.select("path", F.xxhash64("text").alias("_hash"), directory(F.col("path")).alias("_dir"))
    mine = own.select(F.col("path").alias("_own"), F.col("mark").alias("_mark"), "own_license", "own_score")
    told = paths.join(mine, (paths["path"] == mine["_own"]) & (paths["_hash"] == mine["_mark"]), "left").drop("_own", "_mark", "_hash")
    up = told.where("own_license IS NULL AND path IS NOT NULL").select("_dir").distinct().select("_dir", F.posexplode(ancestors(F.concat("_dir", F.lit("/")))).alias("far", "dir"))
    near = up.join(dirs, "dir").groupBy("_dir").agg(F.min_by(F.struct("dir", "d"), "far").alias("near"))
    near = near.select(F.col("_dir").alias("_near"), F.col("near.dir").alias("from_path"), F.col("near.d.own_license").alias("far_license"), F.col("near.d.own_score").alias("far_score"))
    near = F.broadcast(cut(near)) if up.select("_dir").distinct().limit(MOST_SENT + 1).count() <= MOST_SENT else near
    out = told.join(near, (told["_dir"] == near["_near"]) & told["own_license"].isNull(), "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("far_license").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("own_license", "far_license").alias("license"), F.coalesce("own_score", "far_score").alias("score"), origin.alias("origin"), "from_path")
