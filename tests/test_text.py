from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import chunking


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text")).alias("x")).head()["x"]


def test_tokens(spark):
    said = lambda s: one(spark, s, T.tokens)
    assert said("Hello World foo bar") == ["hello", "world", "foo", "bar"]
    assert said("I am a big cat") == ["big", "cat"]
    assert not {"deadbeef", "abc123ff"} & set(said("deadbeef abc123ff real_word 0xCAFE"))
    assert said("port 8432 has 42 connections and 100 users") == ["port", "8432", "connections", "100", "users"]
    assert said("decade facade 123456 12345") == ["12345"]
    assert said("x" * 20 + " " + "y" * 19) == ["y" * 19]
    assert said("Kelvin naïve") == ["elvin"]
    assert said("dog dog") == ["dog", "dog"]
    assert said("") == []


def test_headings(spark):
    for line, level in (("# Title", 1), ("###### L6", 6), ("#NoSpace", 0), ("", 0), ("####### seven", 0)):
        assert one(spark, line, T.heading_level) == level
    assert one(spark, "## A b", T.heading_text) == "A b"


def chunks(spark, text, size):
    return [(c["text"], c["section"]) for c in one(spark, text, lambda c: chunking.chunks(c, size))]


def sequential(text, size):
    """Chunks by a plain loop over paragraphs."""
    import re

    text = re.sub(r"!\[[^\]]*\]\(data:[^)]*\)", "", text)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}", " ", text))
    open_heads, found, now, section = [], [], "", ""
    for p in [x.rstrip("\n\r ") for x in re.split(r"\n(?:\r?\n)+", re.sub(r"\A(\r?\n)+", "", text) + "\n") if x not in ("", "\n")]:
        if m := re.match(r"(#{1,6}) ", p):
            open_heads = [h for h in open_heads if h[0] < len(m[1])] + [(len(m[1]), p)]
            continue
        block, here = "\n\n".join(h[1] for h in open_heads), " » ".join(h[1][h[0] + 1 :] for h in open_heads)
        if now and len(now.encode()) >= size:
            found.append((now, section))
            now = ""
        if not now:
            now = f"{block}\n\n{p}" if block else p
        else:
            now += f"\n\n{block}\n\n{p}" if block and here != section else f"\n\n{p}"
        section = here
    return found + [(now, section)] if now else found


def test_chunks(spark):
    assert chunks(spark, "", 300) == []
    assert chunks(spark, "Hi.", 300) == [("Hi.", "")]
    assert chunks(spark, "one\n\ntwo", 300) == [("one\n\ntwo", "")]
    assert chunks(spark, "# My Document\n\nbody text here", 10) == [("# My Document\n\nbody text here", "My Document")]
    got = chunks(spark, "# A\n\n## A1\n\nalpha words\n\n# B\n\nbeta words", 10)
    assert [s for _, s in got] == ["A » A1", "B"]
    assert len(chunks(spark, "\n\n".join(f"paragraph {i} of twenty with words" for i in range(20)), 50)) > 1
    assert not any("base64" in t for t, _ in chunks(spark, "x ![a](data:image/png;base64,AAAA) y", 10))


def test_chunks_like_a_loop(spark):
    import random

    rng = random.Random(3)
    parts = ["# A", "## B", "### C", "words here", "more é words", "## tail\nwith text", "x", "", "a  b"]
    texts = ["\n\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for size in (1, 30, 1000):
        for r in df.select("text", chunking.chunks(F.col("text"), size).alias("c")).collect():
            assert [(c["text"], c["section"]) for c in r["c"]] == sequential(r["text"], size), r["text"]


def test_paths_previews_escapes(spark):
    assert one(spark, "see /home/ann/a.md and /home/ann/b.md", lambda c: T.short_home(c, "/home/ann")) == "see ~/a.md and ~/b.md"
    assert one(spark, "in /home/ann", lambda c: T.short_home(c, "/home/ann")) == "in /home/ann"
    assert one(spark, "é" * 150, T.preview) == "é" * 100 + "..."
    assert one(spark, "short", T.preview) == "short"
    assert one(spark, "<a & 'b'>\"", T.prompt_escape) == "&lt;a &amp; &#39;b&#39;&gt;&quot;"
    assert one(spark, "test", T.token_hash).startswith("9f86d081") and one(spark, "", T.token_hash).endswith("b855")
    assert one(spark, "I always drink tea", T.worth_capturing) and not one(spark, "tea", T.worth_capturing)
    assert not one(spark, "<b>I always drink</b>", T.worth_capturing)
