import hashlib
import json
import math
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import embedding, routing
from memloom.operators import conversation, metadata, retrieval, store
from memloom.sources import files
from memloom.streaming import sessions, sse

MEMORY = "id long, text string, collection string, category string, tags string, timestamp string, metadata string"


def memories(spark, *rows):
    return spark.createDataFrame([(i, f"t{i}", c, "", tags, ts, meta) for i, (c, tags, ts, meta) in enumerate(rows)], MEMORY)


def test_bm25_order(spark):
    docs = spark.createDataFrame([(0, "the quick brown fox"), (1, "quick dogs"), (2, "search engines"), (3, "quick search of quick things")], "id long, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "quick search")], "query_id long, text string"))
    got = {r["memory_id"]: r["bm25"] for r in retrieval.bm25(retrieval.postings(docs), terms).collect()}
    assert got[3] > got[1] and got[3] > got[2]
    none = retrieval.query_terms(spark.createDataFrame([(0, "zzzznotfound")], "query_id long, text string"))
    assert retrieval.bm25(retrieval.postings(docs), none).count() == 0


def test_hybrid_applies_min_score_last(spark):
    m = spark.createDataFrame([(1, "apple", "food", [1.0, 0.0]), (2, "apple tree", "food", [0.0, 1.0]), (3, "rock", "other", [1.0, 0.1])], "id long, text string, collection string, embedding array<float>")
    q = spark.createDataFrame([(0, "apple", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    posted = retrieval.postings(m)
    how = retrieval.Blend(limit=2, min_score=0.5)
    assert [r["id"] for r in retrieval.hybrid_search(m, posted, q, ["food"], how).collect()] == [1]
    assert {r["id"] for r in retrieval.hybrid_search(m, posted, q, ["*"], how).collect()} == {1, 3}
    assert retrieval.hybrid_search(m.limit(0), posted, q, None, how).count() == 0


def test_metadata_round_trip(spark):
    j = json.dumps({"category": "fact", "tags": ["test", "unit"], "keep": True, "x": 1})
    split = metadata.split_metadata(spark.createDataFrame([(j,)], "metadata string")).head()
    assert (split["collection"], split["category"], split["tags"], split["metadata"]) == ("memory", "fact", "test,unit,keep", '{"x":1}')
    merged = metadata.merge_metadata(metadata.split_metadata(spark.createDataFrame([(j,)], "metadata string"))).head()["metadata"]
    assert json.loads(merged) == {"x": 1, "collection": "memory", "category": "fact", "tags": "test,unit,keep"}


def test_metadata_keeps_its_types(spark):
    """Numbers, booleans, lists and objects come back as they were, and searches find them after a store."""
    extra = {"n": 5, "ok": True, "f": 1.5, "s": "5", "l": [1, "a"], "o": {"k": None, "deep": {"x": 1}}, "nothing": None}
    batch = spark.createDataFrame([("a text", json.dumps({**extra, "collection": "c"})), ("other", None)], "text string, metadata string")
    rows = store.new_rows(batch, 1)
    got = {r["text"]: r["metadata"] for r in rows.collect()}
    assert json.loads(got["a text"]) == extra and got["other"] is None
    assert json.loads(metadata.merge_metadata(rows.where("text = 'a text'")).head()["metadata"]) == {**extra, "collection": "c"}
    found = lambda **fields: [r["text"] for r in metadata.search_by_metadata(rows, fields).collect()]
    assert found(n=5) == found(ok=True) == found(f=1.5) == found(s="5") == ["a text"] and found(n="5") == found(s=5) == []


def test_flags_and_protection(spark):
    df = spark.createDataFrame([("bookkeeping",), ("a",), ("",), ("keep",)], "tags string")
    got = df.select(metadata.with_flag(F.col("tags"), "keep", F.lit(True)).alias("t"), metadata.protected(F.col("tags")).alias("p"), metadata.protected_exactly(F.col("tags")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("bookkeeping", True, False), ("a,keep", False, False), ("keep", False, False), ("keep", True, True)]
    old = spark.createDataFrame([(" a , keep,", True, True)], "t string, k boolean, b boolean")
    assert old.select(metadata.backfilled_tags(F.col("t"), F.col("k"), F.col("b"))).head()[0] == "a,keep,bad"


def test_metadata_search(spark):
    rows = [("c", "", "2024-01-01T00:00:00Z", '{"kind":"fruit","n":1}'), ("c", "", "2024-01-02T00:00:00Z", '{"kind":"fruit","n":1.0}'), ("c", "Red", "2024-01-03T00:00:00Z", '{"kind":"car","n":"1"}'), ("d", "", "2024-01-04T00:00:00Z", None)]
    m = memories(spark, *rows)
    ids = lambda **k: [r["id"] for r in metadata.search_by_metadata(m, **k).collect()]
    assert ids(fields={"kind": "fruit"}) == [1, 0] and ids(fields={"n": 1}) == [1, 0] and ids(fields={"n": "1"}) == [2]
    assert ids(fields={"kind": "none"}) == [] and ids(fields={"kind": "fruit"}, limit=1) == [1]
    assert ids(tag="rED") == [2] and ids(after="2024-01-02T00:00:00Z", before="2024-01-04T00:00:00Z") == [2, 1]
    assert ids(fields={"kind": "fruit"}, limit=1, compat=True) == []


def test_store_changes(spark):
    m = memories(spark, ("c", "keep", "2024-01-01T00:00:00Z", None), ("conversation", "", "2024-01-01T00:00:00Z", None), ("conversation", "keep", "2024-01-01T00:00:00Z", None))
    ids = spark.createDataFrame([(0,), (1,), (99,)], "id long")
    left, gone = store.delete(m, ids)
    assert {r["id"] for r in left.collect()} == {0, 2} and gone.count() == 1
    assert store.delete(m, ids.limit(0))[1].count() == 0
    posted = spark.createDataFrame([(0, "a"), (1, "b")], "memory_id long, token string")
    assert [r["memory_id"] for r in store.cascade(posted, gone).collect()] == [0]
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    assert {r["id"] for r in store.purge(m, 336, now).collect()} == {0, 2}
    assert {r["id"] for r in store.purge(m, 336, now, compat=True).collect()} == {0}
    changes = spark.createDataFrame([(0, "no", "{}"), (1, "yes", '{"category":"x"}')], "id long, text string, metadata string")
    after = {r["id"]: r for r in store.update_text(m, changes).collect()}
    assert after[0]["text"] == "t0" and after[1]["text"] == "yes" and after[1]["collection"] == "memory" and after[1]["timestamp"] == "2024-01-01T00:00:00Z"


def test_store_new_rows(spark):
    batch = spark.createDataFrame([(f"see /h/u/{i}", '{"timestamp":"t"}' if i else None) for i in range(50)], "text string, metadata string")
    got = store.new_rows(batch, 10, "/h/u").collect()
    assert sorted(r["id"] for r in got) == list(range(10, 60)) and all(r["text"].startswith("see ~/") for r in got)
    assert sum(len(r["timestamp"]) == 20 for r in got) == 1


def test_many_rows_get_ids_without_gaps(spark):
    """More than one shuffle target of wide rows, a third of them alike: no row is lost, ids are in the order of text."""
    n = 200_000
    text = F.when(F.col("id") % 3 == 0, F.lit("same ")).otherwise(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" ")))
    wide = spark.range(n).select(F.repeat(text, 10).alias("text"), F.lit("{}").alias("metadata"))
    got = store.new_rows(wide, 1).select("id", F.substring("text", 1, 64).alias("t"))
    assert got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).head()[:] == (n, n, 1, n)
    rows = got.orderBy("id").where("id % 1000 = 0").collect()
    assert [r["t"] for r in rows] == sorted(r["t"] for r in rows)


def test_pairing(spark):
    t = [("assistant", "early"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d"), ("user", " "), ("system", "s"), ("user", "last")]
    turns = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(t)], "conv_id long, turn long, role string, text string")
    assert [(r["user_text"], r["assistant_text"]) for r in conversation.pair_turns(turns).orderBy("turn").collect()] == [("a", ""), ("b", "c"), ("last", "")]
    pair = spark.createDataFrame([("u\nx", "a\ny"), ("u", "")], "u string, a string").withColumn("x", conversation.exchange(F.col("u"), F.col("a")))
    assert [tuple(r) for r in pair.select(*conversation.exchange_parts(F.col("x"))).collect()] == [("u\nx", "a\ny"), ("u", "")]
    assert spark.createDataFrame([("only",)], "x string").select(*conversation.exchange_parts(F.col("x"))).head()[:] == ("only", "")


def test_idle_gap(spark):
    stamps = ["2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-01 00:20:01"]
    e = spark.createDataFrame([(i, 1, s) for i, s in enumerate(stamps)], "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["n_events"] for r in conversation.idle_sessions(e).collect()) == [1, 2]
    assert sorted(r["n_events"] for r in sessions.idle_sessions(e).collect()) == [1, 2]


def test_sse(spark):
    event = lambda s: "data: " + json.dumps({"choices": [{"delta": {"content": s}}]})
    whole = event("Hel") + "\n\n" + event("lo") + "\n\ndata: {bad\n\n: comment\n\ndata: [DONE]\n\n" + event("cut")
    deltas, done, rest = sse.parse_events(whole)
    assert ("".join(deltas), done, rest) == ("Hello", True, event("cut"))
    assert sse.parse_events(event("x") + "\r\n\r\n")[0] == ["x"]
    chunks = spark.createDataFrame([("s", i, whole[i * 7 : i * 7 + 7]) for i in range(len(whole) // 7 + 1)], "stream_id string, seq long, chunk string")
    assert sse.accumulate(chunks).head()[:] == ("s", "Hello", True)


def test_streams(spark, tmp_path):
    event = "data: " + json.dumps({"choices": [{"delta": {"content": "hey"}}]}) + "\n\ndata: [DONE]\n\n"
    spark.createDataFrame([("s", 0, event[:9]), ("s", 1, event[9:])], "stream_id string, seq long, chunk string").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("stream_id string, seq long, chunk string").parquet(str(tmp_path / "in"))
    q = sse.accumulate_stream(live).writeStream.format("memory").queryName("sse_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["text"], r["final"]) for r in spark.table("sse_out").collect()] == [("hey", True)]


def test_sources(spark, tmp_path):
    lines = [{"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hi"}}, {"type": "assistant", "sessionId": "x", "message": {"content": [{"type": "text", "text": "yo"}, {"type": "tool", "text": "no"}]}}]
    (tmp_path / "sess.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{bad\n")
    assert sorted((r["session_id"], r["role"], r["text"]) for r in files.jsonl_turns(spark, str(tmp_path / "sess.jsonl")).collect()) == [("sess", "user", "hi"), ("x", "assistant", "yo")]
    one = [{"uuid": "u", "chat_messages": [{"sender": "human", "text": "q", "created_at": "t"}, {"sender": "assistant", "content": [{"type": "text", "text": "a"}]}]}]
    for k, body in enumerate((one, {"conversations": one})):
        (tmp_path / f"e{k}.json").write_text(json.dumps(body))
        got = files.export_turns(spark, str(tmp_path / f"e{k}.json")).orderBy("seq").collect()
        assert [(r["session_id"], r["role"], r["text"]) for r in got] == [("u", "user", "q"), ("u", "assistant", "a")]


def test_embedding(spark):
    a, b, c = (embedding.hashed(t) for t in ("the cat sat on the mat", "the cat sat on a mat", "stock prices fell"))
    assert a @ b > a @ c and abs(np.linalg.norm(a) - 1) < 1e-4 and np.isfinite(embedding.hashed("")).all()
    df = spark.createDataFrame([([1.0, 2.5],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(embedding.from_blob(embedding.to_blob("v"))).collect()] == [[1.0, 2.5], None]
    hashed = spark.createDataFrame([("pw",)], "p string").select("p", embedding.password_hash(F.col("p"), F.lit("00" * 16), 1000).alias("h"))
    assert hashed.select(embedding.password_matches("p", "h"), embedding.password_matches(F.lit("no"), "h")).head()[:] == (True, False)


def test_routing_and_settings(spark):
    s = routing.load_settings("[search]\nlimit = 50 # many\nbm25_enabled = no\n; note\n[limits]\nmax_search_limit = 10\n")
    assert s.limit == 10 and s.bm25_enabled is False
    assert routing.load_settings("[search]\nlimit = 999\n").limit == 999
    body = spark.createDataFrame([('{"a":[{"b":"x"}],"n":1}',), ("bad",)], "j string")
    assert [r[:] for r in body.select(routing.string_at(F.col("j"), "a[0].b"), routing.string_at(F.col("j"), "n")).collect()] == [("x", ""), ("", "")]
    asked = spark.createDataFrame([(1, "a.b"), (2, "axb"), (3, "zz")], "request_id int, model string")
    ends = spark.createDataFrame([(0, "e0", " a.b ,q*"), (1, "e1", "a?b"), (2, "e2", "")], "ord int, name string, models string")
    assert {r["request_id"]: r["endpoint"] for r in routing.route(asked, ends).collect()} == {1: "e0", 2: "e1", 3: "e2"}


def test_budget(spark):
    from memloom.operators.context import newest, summarizer, within_budget

    files = spark.createDataFrame([("s", 0, "a" * 30, "A"), ("s", 1, "b" * 10 + "\n\n" + "c" * 10 + "\n\n" + "d" * 40, "B"), ("s", 2, "e", "C"), ("t", 0, "x" * 99, "X"), ("u", 0, " \n", "U"), ("u", 1, "ok  \n", "V")], "session string, ord int, text string, label string")
    got = {(r["session"], r["ord"]): r["section"] for r in within_budget(files, 70).collect()}
    assert got == {("s", 0): "a" * 30, ("s", 1): "b" * 10 + "\n\n" + "c" * 10 + "\n\n[... B truncated ...]", ("u", 1): "ok"}
    said = spark.createDataFrame([("One. Two.\n\nThree",), (None,)], "t string")
    assert [r[0] for r in said.select(summarizer()("t")).collect()] == ["One. Three.", ""]
    m = memories(spark, *[("c", "", f"2024-01-0{i}T00:00:00Z", None) for i in range(1, 6)])
    assert sorted(r["id"] for r in newest(m, 2).collect()) == [3, 4]


def test_formats_from_files(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "mine.json").write_text("{bad")
    (tmp_path / "b" / "mine.json").write_text(json.dumps({"path": "/p", "stream_stop": "end", "auth_extra": {"x": "1", "n": 2}, "other": "no"}))
    dirs = (str(tmp_path / "a"), str(tmp_path / "none"), str(tmp_path / "b"))
    got = routing.load_format("mine", dirs)
    assert got == routing.FORMATS["openai"] | {"path": "/p", "stream_stop": "end", "auth_extra": {"x": "1"}}
    assert routing.load_format("", dirs) == routing.FORMATS["openai"] and routing.format_names(dirs) == ["anthropic", "mine", "openai"]
    with pytest.raises(ValueError):
        routing.load_format("unknown", dirs)


def test_lines_stops_and_flushes(spark):
    lines = 'data: {"type":"content_block_delta","delta":{"text":"a"}}\n: c\ndata:{"no":1}\n  data: {"type":"message_stop"} \r\ndata: {"type":"content_block_delta","delta":{"text":"b"}}\ndata: [DONE]\ndata: {"cut'
    chunks = spark.createDataFrame([("s", i, lines[9 * i : 9 * i + 9]) for i in range(len(lines) // 9 + 1)], "stream_id string, seq long, chunk string")
    got = sse.line_deltas(chunks, "delta.text", "type", "content_block_delta", "message_stop").orderBy("place").collect()
    assert [(r["delta"], r["stopped"]) for r in got] == [("a", False), ("", True), ("b", False), ("", False)]
    states = [("a", 200, "u", False, "p"), ("b", 200, "u", True, "q"), ("c", 500, "u", False, "p"), ("d", 204, "u", False, "")]
    df = spark.createDataFrame(states, "session_id string, status int, user_text string, user_flushed boolean, pending string")
    assert sorted(map(tuple, sse.flushed(df).collect())) == [("a", "assistant", "p"), ("a", "user", "u"), ("b", "assistant", "q")]


def test_recall_and_pooling(spark):
    m = spark.createDataFrame([(1, "<apple>", "c", [1.0, 0.0]), (2, "pear", "c", [0.0, 1.0])], "id long, text string, collection string, embedding array<float>")
    asked = spark.createDataFrame([(0, "apple pie", [1.0, 0.0]), (1, "app", [1.0, 0.0]), (2, "nothing near", [-1.0, 0.0])], "query_id long, text string, embedding array<float>")
    got = retrieval.auto_recall(m, retrieval.postings(m), asked).collect()
    assert [r["query_id"] for r in got] == [0] and got[0]["block"].endswith("\n1. &lt;apple&gt;\n</relevant-memories>")
    assert retrieval.corpus_sizes(m.limit(0)).head()[:] == (0, 0)
    v = spark.createDataFrame([([[3.0, 0.0], [9.0, 9.0], [0.0, 4.0]], [1, 0, 1]), ([[1.0, 1.0]], [0])], "t array<array<float>>, m array<int>")
    assert [[round(x, 6) for x in r[0]] for r in v.select(retrieval.mean_pooled(F.col("t"), F.col("m"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    broken = spark.createDataFrame([("s", '[{"role":"user","content":"a"},{"role":"system","content":"b"},{"role":"assistant"},{"role":"assistant","content":"c"}]'), ("t", "{bad")], "session_id string, messages string")
    assert sorted((r["session_id"], r["turn"], r["text"]) for r in conversation.restored_turns(broken).collect()) == [("s", 0, "a"), ("s", 3, "c")]


def test_neighbours_of_any_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "id string, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["id"]): r["rank"] for r in retrieval.knn(v, q, 1).collect()}
    assert got == {("a", "a"): 1, ("b", "b"): 1}
    assert retrieval.knn(v, q.where("query_id = 'c'"), 1).count() == 0 and retrieval.knn(v.limit(0), q, 1).count() == 0


def test_hybrid_batch_by_brute_force(spark):
    """Several queries at once, memories and a query without embeddings, words in common or not: all pairs counted out."""
    rng = np.random.default_rng(5)
    words = "apple pear plum cherry grape melon".split()
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    said = lambda: " ".join(rng.choice(words, 3))
    m = [(i, said() if i % 4 else "zzz", "c" if i % 5 else "d", vec() if i % 7 else None) for i in range(40)]
    q = [(0, "apple plum", vec()), (1, "melon", None), (2, "nothing", vec()), (3, "pear pear grape", vec())]
    mem = spark.createDataFrame(m, "id long, text string, collection string, embedding array<float>")
    ask = spark.createDataFrame(q, "query_id long, text string, embedding array<float>")
    posted, how = retrieval.postings(mem), retrieval.Blend(limit=6, min_score=-1.0)
    found = {(r["query_id"], r["memory_id"]): r["bm25"] for r in retrieval.bm25(posted, retrieval.query_terms(ask)).collect()}

    def cos(a, b):
        return 0.0 if a is None or b is None else float(np.dot(np.float32(a), np.float32(b)) / np.linalg.norm(np.float32(a)) / np.linalg.norm(np.float32(b)))

    want = {}
    for k, _, e in q:
        there = [x for x in m if x[2] == "c"]
        both = np.array([[cos(x[3], e), found.get((k, x[0]), 0.0)] for x in there])
        low, high = both.min(0), both.max(0)
        scaled = np.where(high > low, (both - low) / np.where(high > low, high - low, 1), both)
        total = np.round(7 * scaled[:, 0] + 3 * scaled[:, 1], 6)
        want[k] = [there[i][0] for i in sorted(range(len(there)), key=lambda i: (-total[i], there[i][0]))[:6]]
    got = {}
    for r in retrieval.hybrid_search(mem, posted, ask, ["c"], how).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want


def test_accounts(spark, tmp_path):
    from memloom.operators import accounts
    from memloom.operators.bucket_table import BucketTable

    users = BucketTable(spark, f"file://{tmp_path}/users", ("username",), "modified", buckets=4)
    at = lambda t: F.lit(f"2024-01-0{t} 00:00:00").cast("timestamp")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "username string")
    new = accounts.created(names("ann", "bo", "ann", None), None, at(1))
    tokens = {r["username"]: r["token"] for r in new.collect()}
    users.upsert(new.drop("token"))
    stored = {r["username"]: r for r in users.read().collect()}
    assert stored.keys() == {"ann", "bo"} and len(set(tokens.values())) == 2 and all(len(t) == 43 for t in tokens.values())
    assert all(hashlib.sha256(tokens[u].encode()).hexdigest() == r["token_hash"] for u, r in stored.items())
    assert [r["username"] for r in accounts.created(names("ann", "cy"), users.read()).collect()] == ["cy"]
    users.upsert(accounts.with_passwords(users.read(), spark.createDataFrame([("ann", "secret"), ("nobody", "x"), ("bo", None)], "username string, password string"), 1000, at(2)))
    users.upsert(accounts.with_models(users.read(), spark.createDataFrame([("bo", "m1")], "username string, model string"), at(2)))
    checked = users.read().select("username", embedding.password_matches(F.lit("secret"), "password_hash").alias("ok"), "preferred_model")
    assert sorted(map(tuple, checked.collect())) == [("ann", True, None), ("bo", False, "m1")]
    fresh = accounts.rotated(users.read(), "2024-01-02T00:00:00Z", at(3))
    users.upsert(fresh.drop("token"))
    after = {r["username"]: r for r in users.read().collect()}
    assert all(after[u]["token_hash"] != r["token_hash"] and after[u]["created"] == r["created"] and after[u]["token_rotated_at"] == "2024-01-03T00:00:00Z" for u, r in stored.items())
    assert accounts.rotated(users.read(), "2024-01-03T00:00:00Z").count() == 0
    users.delete(names("bo", "nobody"))
    assert [r["username"] for r in users.read().collect()] == ["ann"]


def test_aliases_order_and_empty_documents(spark, tmp_path):
    from memloom.functions import routing, text
    from memloom.operators import retrieval

    assert routing.load_settings("[models]\nsmall = a/b-1\n[search]\nlimit = 3\n").model_aliases == {"small": "a/b-1"}
    m = spark.createDataFrame([("small",), ("other",), (None,)], "m string")
    assert [r[0] for r in m.select(routing.resolved(F.col("m"), {"small": "a/b-1", "a/b-1": "x"})).collect()] == ["a/b-1", "other", None]
    assert m.select(text.comma_parts(F.lit(" a,\tb ,, c d,"))).head()[0] == ["a", "b", "c d"]
    for name in ("b.md", "a.md", "c.md"):
        (tmp_path / name).write_text(name)
    assert [r["text"] for r in files.text_files(spark, str(tmp_path), in_order=True).collect()] == ["a.md", "b.md", "c.md"]
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple"), (3, ""), (4, None)], "id long, text string")
    posted, terms = retrieval.postings(docs), retrieval.query_terms(spark.createDataFrame([(0, "apple")], "query_id long, text string"))
    n, average = 4, 3 / 4
    want = {i: math.log((n - 2 + 0.5) / 2.5 + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / average)) for i, dl in ((1, 2), (2, 1))}
    got = {r["memory_id"]: r["bm25"] for r in retrieval.bm25(posted, terms, lengths=retrieval.doc_length(posted, docs)).collect()}
    assert got == pytest.approx(want)


def test_bm25_from_postings_of_the_terms(spark):
    """Postings of a query's words and lengths from texts score as all postings do, and only those postings are moved."""
    rows = [(1, "alpha beta beta gamma"), (1, "alpha delta"), (2, "beta the cafe"), (3, None), (4, ""), (5, "omega " * 30 + "ALPHA"), (6, "deadbeef psi")]
    docs = spark.createDataFrame(rows, "id long, text string")
    terms = spark.createDataFrame([(1, "alpha", 1), (1, "beta", 2), (2, "beta", 1), (2, "nowhere", 1), (3, "psi", 1)], "query_id long, token string, qtf long")
    everything = retrieval.postings(docs)
    some, lengths = retrieval.postings(docs, terms=terms), retrieval.text_length(docs)
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in everything.collect() if r["token"] in ("alpha", "beta", "psi"))
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, retrieval.doc_length(everything).collect()))
    scores = lambda df: {(r["query_id"], r["memory_id"]): round(r["bm25"], 9) for r in df.collect()}
    want = scores(retrieval.bm25(everything, terms))
    assert len(want) == 6 and scores(retrieval.bm25(some, terms, lengths=lengths)) == want


def test_texts_of_hits_are_not_shuffled(spark):
    docs = spark.range(50).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    hits = spark.createDataFrame([(1, 7, 2), (1, 9, 1), (2, 7, 1)], "query_id long, id long, rank int")
    said = retrieval.texts_of(hits, docs)
    assert "SortMergeJoin" not in said._jdf.queryExecution().toString() and said.count() == 3
    assert {r["query_id"]: r["context"] for r in retrieval.context_block(hits, docs).collect()} == {1: "text 9\n\n---\n\ntext 7", 2: "text 7"}


def test_workers_hold_slices_of_batches(spark):
    """Models and merging see a bounded number of rows at a time, and blocks of vectors are scored a few queries at a time."""
    seen = lambda: lambda texts: np.full((len(texts), 2), len(texts))
    docs = spark.range(0, 1000, 1, 1).select("id", F.col("id").cast("string").alias("text"))
    sizes = [r["e"][0] for r in docs.select(embedding.embedder(seen)(F.col("text")).alias("e")).collect()]
    assert len(sizes) == 1000 and max(sizes) <= embedding.SLICE
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1.0 / 3, None])], "id long, v array<float>")
    assert [r["h"] is None for r in odd.select(embedding.half("v").alias("h")).collect()] == [True, False, False]
    assert retrieval.TILE * retrieval.BLOCK * 8 <= 1 << 20
