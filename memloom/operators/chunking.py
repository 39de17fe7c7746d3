"""Heading-aware chunks of Markdown.

A document is cleaned and split into paragraphs by column expressions. What follows depends on order alone: `sections` finds the
headings that are open above each paragraph by windows over its document, and `chunks` merges paragraphs in one walk over
them, in time that grows as the document does. Sizes are bytes. A heading paragraph is all heading, even where text follows
it without a blank line; a heading with nothing below it leaves no chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.embedding import sliced
from memloom.functions.text import clean_markdown, heading_level, heading_text, paragraphs

MIN_CHUNK = 300
JOIN, CRUMB = "\n\n", " » "
LEVELS = 6


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place, body, block, section, level: each body paragraph with the headings that are open above it, as they stand and as a breadcrumb, and the deepest one's level.

    A heading of a level is open if it is the last of that level and no heading of a lesser level came after it.
    """
    each = docs.select(key, F.posexplode(paragraphs(clean_markdown(F.col(text)))).alias("place", "body")).withColumn("_l", heading_level(F.col("body")))
    upto = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = {level: F.last(F.when(F.col("_l") == level, F.struct("place", "body")), ignorenulls=True).over(upto) for level in range(1, LEVELS + 1)}
    held = each.select("*", *[c.alias(f"_h{level}") for level, c in last.items()]).where(F.col("_l") == 0)
    lines, deepest, after = [], F.lit(0), F.lit(-1)
    for level in last:
        h = F.col(f"_h{level}")
        open_ = h.isNotNull() & (h["place"] > after)
        lines.append(F.when(open_, h["body"]))
        deepest = F.when(open_, level).otherwise(deepest)
        after = F.greatest(after, F.coalesce(h["place"], F.lit(-1)))
    block = F.concat_ws(JOIN, *lines)
    crumbs = F.concat_ws(CRUMB, *[F.when(x.isNotNull(), heading_text(x)) for x in lines])
    return held.select(key, "place", "body", block.alias("block"), crumbs.alias("section"), deepest.alias("level"))


def _merged(parts: list[str], min_size: int) -> Iterator[tuple[str, str]]:
    """(text, section) of the chunks of one document's paragraphs."""
    open_: list[tuple[int, str]] = []
    block = section = before = ""
    now: list[str] = []
    size = 0
    for p in parts:
        level = len(p) - len(p.lstrip("#"))
        if 1 <= level <= LEVELS and p[level : level + 1] == " ":
            open_ = [h for h in open_ if h[0] < level] + [(level, p)]
            block = JOIN.join(x for _, x in open_)
            section = CRUMB.join(x.partition(" ")[2] for _, x in open_)
            continue
        if size >= min_size and size:
            yield JOIN.join(now), before
            now, size = [], 0
        added = block + JOIN + p if block and (not size or section != before) else p
        size += len(added.encode("utf-8", "surrogatepass")) + (len(JOIN) if size else 0)
        if size:
            now.append(added)
        before = section
    if size:
        yield JOIN.join(now), before


def chunks(text: Column, min_size: int = MIN_CHUNK) -> Column:
    """array<struct<text, section>>: paragraphs merged until a chunk has min_size bytes; the section is that of the last one."""

    kind = pa.list_(pa.struct([("text", pa.string()), ("section", pa.string())]))

    @F.arrow_udf("array<struct<text: string, section: string>>")
    def merge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for documents in batches:
            for some in sliced(documents):
                yield pa.array([None if d is None else [{"text": t, "section": s} for t, s in _merged(d, min_size)] for d in some.to_pylist()], kind)

    return merge(paragraphs(clean_markdown(text)))


def chunk_rows(docs: DataFrame, text: str = "text", min_size: int = MIN_CHUNK, collection: str | None = None) -> DataFrame:
    """docs' other columns with chunk (from 1), total_chunks, chunk_text and section."""
    got = docs.withColumn("_c", chunks(F.col(text), min_size)).drop(text)
    out = got.select("*", F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("_i", "_x")).drop("_c")
    out = out.withColumns({"chunk": F.col("_i") + 1, "chunk_text": F.col("_x.text"), "section": F.col("_x.section")}).drop("_i", "_x")
    return out.withColumn("collection", F.lit(collection)) if collection else out
