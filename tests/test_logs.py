"""Query logs and their sketches, verified backups, ingestion of new files, the text archive."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memloom.operators import backup, query_log
from memloom.operators.bucket_table import BucketTable
from memloom.sources import files
from memloom.streaming import ingest


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_log_lines(spark):
    asked = [("plain", 3, 12.5), ('with "quotes" results=9 time=1ms', 0, 1.0), ("two\nlines", 1, 2.0), ("", 5, 0.0)]
    df = spark.createDataFrame([(datetime(2024, 5, 1, 2, 3, 4), *x) for x in asked], "t timestamp, q string, n int, ms double")
    lines = df.select(query_log.query_line(*[F.col(c) for c in ("t", "q", "n", "ms")]).alias("value"))
    odd = spark.createDataFrame([("2024-05-01 02:03:04 [WARN] query=\"old form\" results=1 time=7ms",), ("2024-05-01T02:03:04Z [INFO] POST /search 200",), ("",), (None,)], "value string")
    got = {r["query"]: r for r in query_log.parsed(lines.unionByName(odd)).collect()}
    assert {q: (r["results"], r["ms"]) for q, r in got.items()} == {"plain": (3, 12.5), asked[1][0]: (0, 1.0), "two lines": (1, 2.0), "": (5, 0.0), "old form": (1, 7.0)}
    assert {str(r["at"]) for r in got.values()} == {"2024-05-01 02:03:04"} and got["old form"]["level"] == "WARN"


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_sketches(spark, accuracy):
    """Quantiles within the bound, and sketches of parts merge to the sketch of all."""
    rng = random.Random(1)
    values = [(i % 7, i % 2, rng.choice([0.0, rng.expovariate(0.1), rng.lognormvariate(3, 2), 5.0])) for i in range(5000)] + [(9, 0, None), (8, 0, 3.0)]
    df = spark.createDataFrame(values, "part int, g int, ms double")
    whole = query_log.sketch(df, "ms", "g", accuracy=accuracy)
    parts = query_log.merged(query_log.sketch(df, "ms", "g", "part", accuracy=accuracy), "g")
    assert rows_of(whole.select("g", "bucket", "n")) == rows_of(parts.select("g", "bucket", "n"))
    for r in query_log.quantiles(parts, "g", accuracy=accuracy).collect():
        mine = sorted(v for _, g, v in values if g == r["g"] and v is not None)
        assert r["n"] == len(mine)
        for share in (0.5, 0.95, 0.99):
            exact = mine[-(-int(share * 10_000) * len(mine) // 10_000) - 1]
            assert abs(r[f"q{round(100 * share)}"] - exact) <= 1.0001 * accuracy * exact
    total = query_log.quantiles(query_log.merged(whole), accuracy=accuracy).collect()
    assert len(total) == 1 and total[0]["n"] == 5001
    assert query_log.quantiles(query_log.sketch(df.limit(0), "ms", "g"), "g").count() == 0


def test_backups(spark, tmp_path):
    """One changed row copies one bucket; what is restored is the source; damage is named."""
    to = BucketTable(spark, f"file://{tmp_path}/b", ("k",), "k", buckets=8)
    schema = "k long, said string, n double"
    rows = [(i, f"row {i}", i / 3) for i in range(60)] + [(None, None, None), (70, "twice", 1.0), (70, "twice", 1.0)]
    df = lambda x: spark.createDataFrame(x, schema)
    assert backup.restored(to) is None if to.read() is None else True
    assert len(backup.back_up(df(rows), to)) == 8 and rows_of(backup.restored(to).select("k", "said", "n")) == sorted(rows, key=repr)
    first = backup.root(backup.stored_hashes(to))
    assert backup.back_up(df(rows[::-1]).repartition(5), to) == []  # the order of rows is nothing
    changed = [(i, s if i != 7 else None, n) for i, s, n in rows]
    assert len(backup.back_up(df(changed), to)) == 1 and rows_of(backup.restored(to).select("k", "said", "n")) == sorted(changed, key=repr)
    assert backup.root(backup.stored_hashes(to)) != first
    once = changed[:-1]  # a repeated row less
    assert len(backup.back_up(df(once), to)) == 1 and rows_of(backup.restored(to).select("k", "said", "n")) == sorted(once, key=repr)
    assert len(backup.back_up(df([]), to)) == 8 and backup.restored(to).count() == 0
    backup.back_up(df(rows), to)
    bucket, version = next(iter(to.versions().items()))
    df([(1000, "slipped in", 0.0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b/rows/bucket={bucket}/version={version}")
    assert len(backup.damaged(to)) == 1
    with pytest.raises(ValueError, match="damaged"):
        backup.restored(to)


def line(role, session, minute, text):
    return json.dumps({"type": role, "timestamp": (datetime(2024, 1, 1) + timedelta(minutes=minute)).isoformat(), "sessionId": session, "message": {"content": text}})


def test_new_files_only(spark, tmp_path):
    """Two runs equal one: questions whose answers come in later files, bad lines, sessions named by their file, nothing twice."""
    drops = [
        {"a.jsonl": [line("user", "s1", 0, "q1"), line("assistant", "s1", 1, "r1"), line("user", "s1", 2, "q2"), "{bad", ""], "b.jsonl": [line("user", "s2", 0, "alone"), line("assistant", None, 3, "no question")]},
        {"c.jsonl": [line("assistant", "s1", 3, "r2"), line("user", "s1", 4, "q3")], "d.jsonl": [line("user", None, 5, "by file")]},
        {"e.jsonl": [line("system", "s1", 6, "no turn"), line("assistant", "s1", 7, "r3")]},
    ]
    at = lambda x: f"file://{tmp_path}/{x}"
    for name in ("in", "all"):
        (tmp_path / name).mkdir()
    for drop in drops:
        for name, lines in drop.items():
            for folder in ("in", "all"):
                (tmp_path / folder / name).write_text("\n".join(lines))
        query = ingest.ingest(spark, at("in"), at("to"), at("c"), buckets=4)
        query.awaitTermination(120)
        assert query.exception() is None
    ingest.ingest(spark, at("in"), at("to"), at("c"), buckets=4).awaitTermination(60)  # nothing new
    columns = ["session_id", "file", "seq", "user_text", "assistant_text"]
    got = rows_of(ingest.stored_pairs(spark, at("to"), 4).read().select(columns))
    assert got == rows_of(ingest.paired(files.jsonl_turns(spark, at("all"))).select(columns))
    assert [(s, u, r) for s, _, _, u, r in got] == [("d", "by file", ""), ("s1", "q1", "r1"), ("s1", "q2", "r2"), ("s1", "q3", "r3"), ("s2", "alone", "")]
    assert ingest.stored_turns(spark, at("to"), 4).read().count() == 9


def test_archive_and_back(spark, tmp_path):
    rows = [("t1", "web", "abcdefghij", "hello\n\nthere", "general"), ("t2", "code", "s2", "=== not a header ===\nx", "a\n\n=== b"), ("2024-01-01T00:00:00Z", "web", "s3", "only user", ""), ("", "web", "", "User: said", "Assistant: said")]
    turns = spark.createDataFrame(rows, "timestamp string, source string, session_id string, user_text string, assistant_text string")
    files.archive_lines(turns).coalesce(1).write.text(f"{tmp_path}/archive")
    back = files.archive_turns(spark.read.text(f"{tmp_path}/archive", wholetext=True)).orderBy("place")
    assert [tuple(r) for r in back.drop("place").collect()] == [(t, s, i[:8], u, a) for t, s, i, u, a in rows]
