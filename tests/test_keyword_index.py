"""The stored keyword index: equal to a fresh one after every change, ties included, without moving postings, and skipping blocks."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.functions.text import tokens
from memloom.operators import keyword_index, tallies
from memloom.operators import retrieval as R
from memloom.operators.keyword_index import KeywordIndex

WORDS = [f"word{chr(97 + i)}x" for i in range(26)]


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def ranked(scored, how):
    best = scored.select("query_id", F.col("memory_id").alias("id"), F.lit(0.0).alias("score"), "bm25", F.col("bm25").alias("combined"))
    return {(r["query_id"], r["rank"]): (r["id"], round(r["bm25"], 5)) for r in R.top(best, how).collect()}


def found(index, terms, how):
    return {(r["query_id"], r["rank"]): (r["id"], round(r["bm25"], 5)) for r in index.search(terms, how).collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = {i: " ".join(rng.choices(WORDS, range(26, 0, -1), k=rng.choice([3, 8, 30]))) for i in range(300)}
    rows |= {i: "worda wordb copies" for i in range(300, 340)} | {400: None, 401: "", 402: "a b"}
    index = KeywordIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/kept", buckets=4, hot=50, shard=8)
    return index, rows


def test_changes(spark, made):
    index, rows = made
    how = R.Blend(limit=7)
    terms = R.query_terms(spark.createDataFrame([(0, "wordax wordbx wordzx wordzx"), (1, "copies worda"), (2, "nothing"), (3, "wordyx wordvx copies"), (4, "fresh")], "query_id long, text string"))
    assert index.stats().docs == 0 and index.search(terms, how).count() == index.bm25(terms).count() == 0

    def same():
        fresh = R.postings(texts(spark, list(rows.items())))
        kept = index.postings()
        assert sorted(map(tuple, kept.select("memory_id", "token", "term_freq").collect())) == sorted(map(tuple, fresh.collect()))
        want = ranked(R.bm25(fresh, terms), how)
        assert ranked(index.bm25(terms), how) == want and found(index, terms, how) == want

    index.add(texts(spark, [x for x in rows.items() if x[0] % 2]))
    index.add(texts(spark, [x for x in rows.items() if not x[0] % 2]))
    same()
    gone = [i for i in rows if i % 9 == 0] + [77_777]
    index.remove(texts(spark, [(i, "") for i in gone]).select("id"))
    for i in gone:
        rows.pop(i, None)
    index.merge()
    same()
    new = {i: "wordax fresh text" for i in (1, 9, 10, 500)} | {3: None}
    index.add(texts(spark, list(new.items())))
    rows.update(new)
    index.remove(texts(spark, [(10, ""), (310, "")]).select("id"))
    rows.pop(10), rows.pop(310)
    same()
    index.merge()
    index.vacuum()
    assert len(index.ledger.committed()) == 1
    same()


def test_lost_changes_do_not_count(spark, made):
    """A change that wrote its rows but never ended is not seen, nor is its number used again."""
    index, _ = made
    before, number = index.stats(), index.ledger.claim()
    lost = texts(spark, [(9000, "wordax")]).select(F.lit("wordax").alias("token"), F.lit(0).alias("part"), F.col("id").alias("memory_id"), F.lit(1).alias("term_freq"), F.lit(1).cast("long").alias("dl"), F.lit(number).cast("long").alias("epoch"))
    index._append("postings", before.generation, lost)
    assert index.postings().where("memory_id = 9000").isEmpty() and index.stats() == before and index.ledger.claim() > number


def test_no_exchange_of_postings(spark, made):
    """Between the scan of the postings and their join with the terms nothing is shuffled, broadcast or not."""
    index, _ = made
    terms = R.query_terms(spark.createDataFrame([(0, "wordax copies")], "query_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.hits(terms)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, line in enumerate(plan) if "Scan parquet" in line and "memloom_postings" in line)
    depth = plan[at].index("+-") if "+-" in plan[at] else plan[at].index(":-")
    above = []
    for line in reversed(plan[:at]):
        d = min((line.index(x) for x in ("+-", ":-") if x in line), default=0)
        if d < depth:
            above.append(line)
            depth = d
        if "Join" in line and d <= depth:
            break
    assert "Bucketed: true" in plan[at] and any("Join" in x for x in above) and not any("Exchange" in x for x in above)


def test_blocks_are_skipped(spark, tmp_path):
    """A few memories match a query far better than the rest: most blocks aren't read, and the results are the same."""
    rng = random.Random(2)
    many = [f"{w}{v}" for w in WORDS for v in WORDS]
    rows = [(i, " ".join([*rng.choices(many, k=rng.randint(20, 60)), rng.choice(WORDS[:3])])) for i in range(600)] + [(1000 + i, "wordax wordbx wordcx") for i in range(12)]
    index = KeywordIndex(spark, f"file://{tmp_path}/kept", buckets=4, shard=16)
    index.add(texts(spark, rows))
    index.merge()
    terms = R.query_terms(spark.createDataFrame([(0, "wordax wordbx wordcx")], "query_id long, text string"))
    chosen = {r["read"]: r["n"] for r in index.choice(index.weights(terms)).groupBy("read").agg(F.sum("blocks").alias("n")).collect()}
    assert chosen[False] > 10 * chosen[True]
    assert found(index, terms, R.Blend()) == ranked(R.bm25(R.postings(texts(spark, rows)), terms), R.Blend())


def shuffled(spark):
    """Bytes that this session's tasks have shuffled."""
    spark.range(1).count()
    time.sleep(0.5)  # figures are kept up to date every 0.1 s
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_deleting_moves_no_postings(spark, tmp_path, monkeypatch):
    """Deleting many ids, more than are broadcast, moves what the deleted memories hold, not all postings, and a merge moves each only by shard and token."""
    monkeypatch.setattr(keyword_index, "MOST_SENT", 0)
    rng = random.Random(3)
    many = [f"{w}{v}" for w in WORDS for v in WORDS]
    rows = [(i, " ".join(rng.choices(many, k=100))) for i in range(1500)]
    index = KeywordIndex(spark, f"file://{tmp_path}/kept", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = [shuffled(spark)]
        for change in (lambda: index.add(texts(spark, rows)), lambda: index.remove(texts(spark, [(i, "") for i in range(20)]).select("id")), index.merge):
            change()
            at.append(shuffled(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    added, removed, merged = (b - a for a, b in zip(at, at[1:]))
    assert removed < added / 4 and merged < 2 * added
    assert index.stats().docs == 1480


def test_results_do_not_depend_on_sizes(spark, tmp_path, monkeypatch):
    """Nothing broadcast, a bucket for a few memories, slices of a few tokens, common tokens in parts: the same postings and ranks, from another session's tables as well."""
    monkeypatch.setattr(keyword_index, "MOST_SENT", 0)
    monkeypatch.setattr(keyword_index, "FULL", 20)
    monkeypatch.setattr(tallies, "MOST_TOKENS", 50)
    monkeypatch.setattr(tallies, "MOST_BYTES", 100)
    rng = random.Random(4)
    rows = {i: " ".join(rng.choices(WORDS, range(26, 0, -1), k=rng.choice([3, 8, 30]))) for i in range(150)}
    index = KeywordIndex(spark, f"file://{tmp_path}/kept", buckets=2, hot=30, shard=8)
    index.add(texts(spark, list(rows.items())))
    index.merge()
    assert index.stats().buckets == 8
    index.add(texts(spark, [(1, "wordax wordzx"), (200, "wordax wordax")]))
    index.remove(texts(spark, [(i, "") for i in range(2, 30)]).select("id"))
    rows = {i: x for i, x in rows.items() if i not in range(2, 30)} | {1: "wordax wordzx", 200: "wordax wordax"}
    terms = R.query_terms(spark.createDataFrame([(0, "wordax wordbx wordzx wordzx"), (1, "wordyx")], "query_id long, text string"))
    fresh = R.postings(texts(spark, list(rows.items())))
    for name in [x.name for x in spark.catalog.listTables() if x.name.startswith("memloom_")]:
        spark.sql(f"DROP TABLE {name}")
    again = KeywordIndex(spark, index.path, buckets=2, hot=30, shard=8)
    assert sorted(map(tuple, again.postings().select("memory_id", "token", "term_freq").collect())) == sorted(map(tuple, fresh.collect()))
    want = ranked(R.bm25(fresh, terms), R.Blend())
    assert found(again, terms, R.Blend()) == want and ranked(again.bm25(terms), R.Blend()) == want


def test_words_of_slices(spark):
    """Words that are counted on Arrow arrays are those of the column expression."""
    odd = ["", "ab", "abc", "The CAT sat", "x" * 19 + " " + "y" * 20, "abcdef abcde 123456 12345 a1b2c3d4 a1b2c3g4", "Kelvin Kelvin naïve straße", "one\x00two\tthree\nfour", "endhere", "startshere abc", "İstanbul \U0001f600smile", "AND should Should"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id long, text string")
    want = {(r["id"], t) for r in df.select("id", tokens(F.col("text")).alias("t")).collect() for t in r["t"]}
    for a in (pa.array(odd), pa.array(odd, pa.large_string()), pa.array(["cutoff", *odd]).slice(1)):
        row, code, named = tallies.words(a)
        assert {(r, named[c].as_py()) for r, c in zip(row.tolist(), code.tolist())} == want
    invalid = df.select(F.lit(1).cast("long").alias("id"), F.unhex(F.lit("616263FF646566C3")).cast("string").alias("text")).limit(1)
    assert invalid.mapInArrow(tallies.tallied, tallies.TALLY).first()["tokens"] == ["abc", "def"]
