"""Stored tables and streams into them: bucket merges, periods, settled turns, housekeeping."""

import random
import time
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memloom.operators import periods, store
from memloom.operators.bucket_table import BucketTable, merge_stream
from memloom.streaming import ordered, sessions, sse, turns


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def kv(spark, rows):
    return spark.createDataFrame(rows, "k long, v long, said string")


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", ("k",), "v", buckets=8)
    assert table.read() is None and table.upsert(kv(spark, [])) is None
    first = [(i, 1, f"a{i}") for i in range(50)] + [(None, 1, "null")]
    table.upsert(kv(spark, first))
    before = files_of(tmp_path / "t" / "rows")
    changes = [(3, 2, "new"), (3, 5, "newer"), (4, 0, "older"), (77, 1, None)]
    number = table.upsert(kv(spark, changes), "one")
    after = files_of(tmp_path / "t" / "rows")
    assert {k: after[k] for k in before} == before  # nothing is overwritten
    touched = {f.split("/")[0] for f in after.keys() - before.keys()}
    assert 1 <= len(touched) <= 3 and {f"bucket={b}" for b, v in table.versions().items() if v == number} == touched
    want = store.upsert(kv(spark, [r for r in first if r[0] != 4]), kv(spark, [(3, 5, "newer"), (77, 1, None)]), "k").unionByName(kv(spark, [first[4]]))
    assert rows_of(table.read().select("k", "v", "said")) == rows_of(want)
    assert table.upsert(kv(spark, [(3, 99, "again")]), "one") == number and rows_of(table.read().select("k", "v", "said")) == rows_of(want)
    table.delete(kv(spark, [(3, 0, ""), (None, 0, ""), (500, 0, "")]).select("k"))
    left = [r for r in rows_of(want) if r[0] not in (3, None)]
    assert rows_of(table.read().select("k", "v", "said")) == left
    table.vacuum()
    assert len(files_of(tmp_path / "t" / "rows")) < len(after) and rows_of(table.read().select("k", "v", "said")) == left


def test_a_lost_change_is_not_seen(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", ("k",), "v", buckets=4)
    table.upsert(kv(spark, [(1, 1, "a"), (2, 1, "b")]))
    claimed = table.ledger.claim()  # a writer that dies after its files and before its line
    kv(spark, [(1, 9, "lost")]).withColumns({"bucket": table._bucket(), "version": F.lit(claimed)}).write.mode("append").partitionBy("bucket", "version").parquet(f"{table.path}/rows")
    table.upsert(kv(spark, [(2, 2, "c")]))
    assert rows_of(table.read().select("k", "v", "said")) == [(1, 1, "a"), (2, 2, "c")]


def test_streams_merge_once(spark, tmp_path):
    """Batches are put in once, also where one is run again after it was put in and before the stream knew."""
    at = lambda name: f"file://{tmp_path}/{name}"
    table = BucketTable(spark, at("t"), ("k",), "v", buckets=4)

    def step(*rows):
        kv(spark, rows).coalesce(1).write.mode("append").parquet(at("in"))
        merge_stream(spark.readStream.schema("k long, v long, said string").parquet(at("in")), table, at("c")).awaitTermination(90)

    step((1, 1, "a"), (2, 1, "b"))
    step((2, 5, "c"), (3, 1, "d"))
    want = [(1, 1, "a"), (2, 5, "c"), (3, 1, "d")]
    assert rows_of(table.read().select("k", "v", "said")) == want
    for name in ("1", ".1.crc"):
        (tmp_path / "c" / "commits" / name).unlink()
    number = max(table.versions().values())
    merge_stream(spark.readStream.schema("k long, v long, said string").parquet(at("in")), table, at("c")).awaitTermination(90)
    assert rows_of(table.read().select("k", "v", "said")) == want and max(table.versions().values()) == number


def test_housekeeping(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    now = datetime(2024, 1, 10, tzinfo=timezone.utc)
    stamp = lambda h: (now - timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")
    memories = BucketTable(spark, at("m"), ("id",), "timestamp", buckets=4)
    memories.upsert(spark.createDataFrame([(1, "conversation", "", stamp(30)), (2, "conversation", "keep", stamp(30)), (3, "conversation", "", stamp(2)), (4, "memory", "", stamp(99))], "id long, collection string, tags string, timestamp string"))
    spark.range(1).write.parquet(at("tick"))
    for hours, left in ((24, [2, 3, 4]), (1, [2, 4])):
        sessions.housekeep(spark.readStream.schema("id long").parquet(at("tick")), memories, at(f"c{hours}"), hours, lambda: now).awaitTermination(90)
        assert sorted(r["id"] for r in memories.read().collect()) == left


def test_valid_periods(spark):
    """Against a scan of each user's rotations: hot users, equal times, gaps, ends, nulls, requests before all."""
    rng = random.Random(1)
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    user = lambda: rng.choice([1, 1, 1, 2, 3, 4])
    rotations = [(user(), t(rng.randrange(0, 5000)), f"k{i}") for i in range(120)] + [(1, t(100), "x"), (1, t(100), "y"), (9, t(10), "nine")]
    requests = [(i, user(), t(rng.randrange(-500, 6000))) for i in range(400)] + [(1000, 1, t(100)), (1001, None, t(5)), (1002, 1, None), (1003, 8, t(5))]
    held = periods.periods(spark.createDataFrame(rotations, "user_id long, rotated_at timestamp_ntz, token string"), last_for=F.expr("INTERVAL 300 MINUTES"))
    got = {r["id"]: r["token"] for r in periods.valid_at(spark.createDataFrame(requests, "id long, user_id long, ts timestamp_ntz"), held, bin_seconds=3600).collect()}
    assert len(got) == len(requests)
    for i, u, at in requests:
        past = [(since, token) for v, since, token in rotations if at and v == u and since <= at]
        last = max(past, default=None)
        assert got[i] == (last[1] if last and at < last[0] + timedelta(minutes=300) else None)


def test_settled_turns_of_streams(spark, tmp_path):
    """Final in time, lost, late and without a partial, batch by batch: in the end what the batch twin gives."""
    at = lambda name: f"file://{tmp_path}/{name}"
    t = lambda m: datetime(2024, 1, 1, 12) + timedelta(minutes=m)
    schema = "turn_id long, ts timestamp, text string"
    steps = [
        ([(1, t(0), "p1"), (2, t(1), "p2"), (3, t(2), "p3")], [(9, t(1), "f9")]),
        ([(4, t(6), "p4")], [(1, t(5), "f1"), (4, t(7), "f4")]),
        ([(90, t(40), "mark")], [(91, t(40), "mark"), (3, t(30), "too late")]),
        ([(92, t(90), "mark")], [(93, t(90), "mark")]),
    ]
    out = []
    for partials, finals in steps:
        for name, rows in (("p", partials), ("f", finals)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at(name))
        streams = [spark.readStream.schema(schema).parquet(at(name)) for name in ("p", "f")]
        q = turns.settled(*streams).writeStream.format("parquet").option("path", at("out")).option("checkpointLocation", at("c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    out = [r for r in rows_of(spark.read.parquet(at("out")).select("turn_id", "text", "state")) if r[0] < 90]
    twin = turns.settled(*[spark.read.schema(schema).parquet(at(name)) for name in ("p", "f")]).select("turn_id", "text", "state")
    assert out == [r for r in rows_of(twin) if r[0] < 90]
    assert sorted(out) == [(1, "f1", "final"), (2, "p2", "partial"), (3, "p3", "partial"), (3, "too late", "fresh"), (4, "f4", "final"), (9, "f9", "fresh")]


@pytest.mark.parametrize("rows", [[], [(1, datetime(2024, 1, 1), "a")]])
def test_empty_periods(spark, rows):
    held = periods.periods(spark.createDataFrame(rows, "user_id long, rotated_at timestamp_ntz, token string"))
    asked = spark.createDataFrame([(1, 1, datetime(2023, 1, 1))], "id long, user_id long, ts timestamp_ntz")
    assert [r["token"] for r in periods.valid_at(asked, held).collect()] == [None]
    assert periods.valid_at(asked.limit(0), held).count() == 0


def event(text):
    return 'data: {"choices":[{"delta":{"content":"%s"}}]}\n\n' % text


def test_chunks_in_any_order(spark, tmp_path):
    """Pieces of events shuffled over many micro-batches, some twice: the text of accumulate()."""
    rng = random.Random(7)
    at = lambda name: f"file://{tmp_path}/{name}"
    rows = []
    for s in range(12):
        said = "".join(event(f"w{s}.{i} ") for i in range(rng.randint(1, 8))) + "data: [DONE]\n\n"
        cuts = sorted({0, len(said), *(rng.randrange(len(said)) for _ in range(6))})
        rows += [(str(s), i, said[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    whole = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    sent = rows + rows[::5]
    rng.shuffle(sent)
    for k in range(5):
        spark.createDataFrame(sent[k::5], whole.schema).coalesce(1).write.mode("append").parquet(at("in"))
    ordered.text_of(spark, at("in"), at("out"), at("c"), flush_seconds=3600, give_up_seconds=3600)
    assert rows_of(spark.read.parquet(at("out")).select("stream_id", "text", "final")) == rows_of(sse.accumulate(whole).select("stream_id", "text", "done"))


def test_pauses_gaps_and_ends(spark, tmp_path):
    """A pause flushes what has come, a lost chunk is given up, the end flushes the rest, and what comes later is ignored."""
    at = lambda name: f"file://{tmp_path}/{name}"
    schema = "stream_id string, seq long, chunk string"

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at("in"))

    def wait(what):
        for _ in range(120):
            if {tuple(r) for r in spark.table("pauses").collect()} >= what:
                return
            time.sleep(0.5)
        raise AssertionError(spark.table("pauses").collect())

    spark.conf.set(*ordered.STORE)
    send(("a", 1, event("two")), ("a", 0, event("one ")), ("b", 0, event("x") + "data: [DONE]\n\n"))
    live = spark.readStream.schema(schema).parquet(at("in"))
    q = ordered.accumulate_ordered(live, 1, 3).writeStream.format("memory").queryName("pauses").option("checkpointLocation", at("c")).outputMode("append").trigger(processingTime="0 seconds").start()
    try:
        wait({("a", 0, "one two", False), ("b", 0, "x", True)})
        send(("a", 3, event("behind the gap")), ("b", 1, event("late")))
        wait({("a", 1, "behind the gap", False)})
        send(("a", 4, event("last") + "data: [DONE]\n\n"), ("a", 2, event("too late")))
        wait({("a", 2, "last", True)})
        assert sorted(map(tuple, spark.table("pauses").collect())) == [("a", 0, "one two", False), ("a", 1, "behind the gap", False), ("a", 2, "last", True), ("b", 0, "x", True)]
    finally:
        q.stop()
        spark.conf.unset(ordered.STORE[0])
