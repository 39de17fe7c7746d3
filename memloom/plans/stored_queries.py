"""Queries over tables that are stored and kept up: they write to a scratch folder what the given tables hold, change it, and read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import backup, conversation, periods, query_log
from memloom.operators import retrieval as R
from memloom.operators.bucket_table import BucketTable
from memloom.operators.keyword_index import KeywordIndex
from memloom.operators.lineage import scratch
from memloom.plans.catalog import query, spread, table
from memloom.plans.memory_queries import _PAIRS, stream_chunks
from memloom.plans.memory_queries import turns as all_turns
from memloom.plans.retrieval_queries import BM25, ITEM_TERMS, POSTINGS, STATS
from memloom.sources import files
from memloom.streaming import ingest, ordered, turns

_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fresh words ' || text ELSE text END AS text FROM documents WHERE (doc_id % 7 <> 0 OR doc_id % 5 = 0) AND doc_id % 11 <> 0)"
_TOP = f"""WITH {POSTINGS.replace("FROM documents", "FROM " + _CHANGED)}, {STATS}, {ITEM_TERMS}, {BM25}
SELECT query_id, memory_id AS id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, memory_id) AS rank FROM bm25 QUALIFY rank <= 5"""


def kept_index(spark: SparkSession, sf_dir: str, merge: bool) -> KeywordIndex:
    """An index of the documents after two adds, a delete, perhaps a merge, replacements and another delete."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    index = KeywordIndex(spark, scratch(spark, "keyword-index"), buckets=8)
    index.add(docs.where("id % 3 <> 0"))
    index.add(docs.where("id % 3 = 0"))
    index.remove(docs.where("id % 7 = 0").select("id"))
    if merge:
        index.merge()
    index.add(docs.where("id % 5 = 0").select("id", F.concat(F.lit("fresh words "), "text").alias("text")))
    index.remove(docs.where("id % 11 = 0").select("id"))
    return index


def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.query_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(_TOP)
def stored_index_search(spark, sf_dir):
    """The best memories of each benchmark item over stored postings that have been added to and deleted from."""
    scored = kept_index(spark, sf_dir, False).bm25(item_terms(spark, sf_dir))
    best = scored.select("query_id", F.col("memory_id").alias("id"), F.lit(0.0).alias("score"), "bm25", F.col("bm25").alias("combined"))
    return R.top(best, R.Blend()).select("query_id", "id", F.round("bm25", 6).alias("bm25"), "rank")


@query(_TOP)
def block_max_search(spark, sf_dir):
    """The same after a merge, from the blocks that can matter and what has changed since."""
    found = kept_index(spark, sf_dir, True).search(item_terms(spark, sf_dir))
    return found.select("query_id", "id", F.round("bm25", 6).alias("bm25"), "rank")


_CUT = "event_id < (SELECT 2 * max(event_id) // 3 FROM events)"


@query(
    f"""WITH a AS (SELECT user_id, event_type, event_id FROM events), first AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM a WHERE {_CUT} GROUP BY user_id),
later AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM a WHERE NOT {_CUT} AND user_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(t.user_id, f.user_id) AS user_id, coalesce(t.event_type, f.event_type) AS event_type, coalesce(t.event_id, f.event_id) AS event_id FROM first f FULL JOIN later t ON f.user_id = t.user_id
WHERE coalesce(t.user_id, f.user_id) % 10 <> 1"""
)
def bucket_merge(spark, sf_dir):
    """The latest event of each user in a stored table: a first load, changes of every third user put in twice under one name, and deletes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    cut_at = e.agg((2 * F.max("event_id") / 3).cast("long").alias("cut"))
    e = e.crossJoin(F.broadcast(cut_at))  # one row
    kept = BucketTable(spark, scratch(spark, "bucket-table"), ("user_id",), "event_id", buckets=16)
    kept.upsert(e.where("event_id < cut").drop("cut"))
    for _ in range(2):
        kept.upsert(e.where("event_id >= cut AND user_id % 3 = 0").drop("cut"), "again")
    kept.delete(e.where("user_id % 10 = 1").select("user_id"))
    return kept.read()


@query(
    """WITH r AS (SELECT user_id, ts, max(event_id) AS token FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id, ts),
p AS (SELECT *, least(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), ts + INTERVAL 5 DAY) AS until FROM r)
SELECT e.event_id AS event_id, p.token AS token FROM events e LEFT JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts AND (until IS NULL OR e.ts < until) WHERE e.event_type NOT IN ('signup', 'purchase')"""
)
def token_at_request(spark, sf_dir):
    """Which token each request had: tokens rotate at sign-ups and purchases and last five days."""
    e = table(spark, sf_dir, "events")
    made = e.where("event_type IN ('signup', 'purchase')").select("user_id", F.col("ts").alias("rotated_at"), F.col("event_id").alias("token"))
    held = periods.periods(made, last_for=F.make_dt_interval(F.lit(5)))
    asked = e.where("event_type NOT IN ('signup', 'purchase')").select("event_id", "user_id", "ts")
    return periods.valid_at(asked, held, bin_seconds=2 * 86_400).select("event_id", "token")


@query(
    """WITH p AS (SELECT event_id AS turn_id, ts, 'so far ' || event_type AS text FROM events WHERE event_type <> 'error'),
f AS (SELECT event_id AS turn_id, ts + to_minutes(CAST(event_id % 20 AS BIGINT)) AS ts, 'all of ' || event_type AS text FROM events WHERE event_id % 3 = 0)
SELECT coalesce(f.turn_id, p.turn_id) AS turn_id, CASE WHEN f.turn_id IS NULL THEN p.text ELSE f.text END AS text, CASE WHEN f.turn_id IS NULL THEN 'partial' WHEN p.turn_id IS NULL THEN 'fresh' ELSE 'final' END AS state
FROM p FULL JOIN f ON p.turn_id = f.turn_id AND f.ts >= p.ts AND f.ts <= p.ts + INTERVAL 10 MINUTE"""
)
def settled_turns(spark, sf_dir):
    """Partial turns and their final forms, of which some come too late, some never, and some without a partial: the batch twin of the join of streams."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    partials = e.where("event_type <> 'error'").select(F.col("event_id").alias("turn_id"), "ts", F.concat(F.lit("so far "), "event_type").alias("text"))
    ended = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 20).cast("int"))
    finals = e.where("event_id % 3 = 0").select(F.col("event_id").alias("turn_id"), ended.alias("ts"), F.concat(F.lit("all of "), "event_type").alias("text"))
    return turns.settled(partials, finals).select("turn_id", "text", "state")


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, string_agg(text, '' ORDER BY turn) AS text, TRUE AS final FROM conversations GROUP BY conv_id")
def ordered_streams(spark, sf_dir):
    """Conversations as token streams whose chunks, halves of events, come shuffled in four micro-batches."""
    whole = stream_chunks(spark, sf_dir)
    middle = F.floor(F.length("chunk") / 2).cast("int")
    halves = F.array(F.struct((2 * F.col("seq")).alias("seq"), F.substring("chunk", F.lit(1), middle).alias("chunk")), F.struct((2 * F.col("seq") + 1).alias("seq"), F.substring("chunk", middle + 1, F.length("chunk")).alias("chunk")))
    chunks = whole.select(F.col("stream_id").cast("string"), F.explode(halves).alias("h")).select("stream_id", "h.seq", "h.chunk")
    at, to, checkpoint = (scratch(spark, f"streams-{x}") for x in ("in", "out", "state"))
    chunks.repartitionByRange(4, F.xxhash64("stream_id", "seq")).write.parquet(at)
    ordered.text_of(spark, at, to, checkpoint, flush_seconds=3600, give_up_seconds=3600)
    return spark.read.parquet(to).select("stream_id", "text", "final")


@query(f"WITH {_PAIRS} SELECT CAST(conv_id AS VARCHAR) AS session_id, printf('%06d', turn) AS timestamp, user_text, assistant_text FROM pairs")
def jsonl_ingest(spark, sf_dir):
    """Conversations as JSONL logs that come in two drops, so that many answers are in later files than their questions; the second run reads new files only."""
    said = F.to_json(F.struct(F.col("role").alias("type"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("timestamp"), F.col("conv_id").cast("string").alias("sessionId"), F.struct(F.col("text").alias("content")).alias("message")))
    lines = all_turns(spark, sf_dir).where("role IN ('user', 'assistant')").select(said.alias("value"), "conv_id", "turn")
    at, to, checkpoint = (scratch(spark, f"ingest-{x}") for x in ("in", "tables", "state"))
    for first in (True, False):
        lines.where((F.col("turn") <= 2 + F.col("conv_id") % 2) == first).repartition(4, "conv_id").sortWithinPartitions("conv_id", "turn").select("value").write.mode("append").text(at)
        ingest.ingest(spark, at, to, checkpoint, buckets=8).awaitTermination()
    return ingest.stored_pairs(spark, to, 8).read().select("session_id", "timestamp", "user_text", "assistant_text")


_SCALE = query_log._scale(0.01)


@query(
    f"""WITH v AS (SELECT CAST(ts AS DATE) AS day, abs(value) AS ms FROM events WHERE value IS NOT NULL),
b AS (SELECT day, CASE WHEN ms > 0 THEN CAST(ceil(round(ln(ms) / {_SCALE!r}, 9)) AS BIGINT) END AS bucket, count(*) AS n FROM v GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY day ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY day) AS total FROM b),
q AS (SELECT day, CAST(max(total) AS BIGINT) AS n, {", ".join(f"coalesce(round(exp(min(coalesce(bucket, -100000)) FILTER (upto >= ceil(CAST({s} AS DOUBLE) * total)) * {_SCALE!r}) * 0.99, 4), 0) AS q{round(100 * s)}" for s in (0.5, 0.95, 0.99))} FROM u GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, n, q50, q95, q99, TRUE AS within FROM q"""
)
def latency_sketches(spark, sf_dir):
    """Latencies of a query log, sketched by hour, the hours merged to days; within: whether the 95th of 100 is as near the exact one as the sketch says."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    lines = e.select(query_log.query_line(F.col("ts").cast("timestamp"), F.concat(F.lit('say "'), "event_type", F.lit('" results=7')), F.col("event_id"), F.abs("value").cast("decimal(18,2)")).alias("value"))
    log = query_log.parsed(lines).withColumn("hour", F.date_trunc("hour", "at"))
    hours = query_log.sketch(log, "ms", "hour")
    days = query_log.merged(hours.withColumn("day", F.date_format("hour", "yyyy-MM-dd")), "day")
    exact = log.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("_p"))
    near = F.abs(F.col("q95") - F.col("_p")) <= 0.0100001 * F.col("_p")
    return query_log.quantiles(days, "day").join(exact, "day").select("day", "n", *[F.round(c, 4).alias(c) for c in ("q50", "q95", "q99")], near.alias("within"))


@query("SELECT event_id, user_id, CASE WHEN user_id = 7 THEN 'changed' ELSE event_type END AS event_type, 1 AS copied FROM events WHERE user_id <> 8")
def incremental_backup(spark, sf_dir):
    """Events restored from a backup made twice: between, one user's rows changed and another's went; copied: how many of these two users' buckets the second copied, over how many they have."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    to = BucketTable(spark, scratch(spark, "backup"), ("user_id",), "event_id", buckets=16)
    backup.back_up(e, to)
    now = e.where("user_id <> 8").withColumn("event_type", F.when(F.col("user_id") == 7, "changed").otherwise(F.col("event_type")))
    copied = backup.back_up(now, to)
    touched = e.where("user_id IN (7, 8)").select(to._bucket().alias("b")).distinct().count()
    return backup.restored(to).withColumn("copied", F.lit(int(len(copied) == touched)))


@query(f"WITH {_PAIRS} SELECT CAST(turn AS VARCHAR) AS timestamp, 'web' AS source, substring('s' || conv_id, 1, 8) AS session, user_text, assistant_text FROM pairs")
def archive_roundtrip(spark, sf_dir):
    """Turns written as a text archive, and read back from its files."""
    pairs = conversation.pair_turns(all_turns(spark, sf_dir)).withColumns({"session_id": F.concat(F.lit("s"), F.col("conv_id").cast("string")), "source": F.lit("web"), "timestamp": F.col("turn").cast("string")})
    at = scratch(spark, "archive")
    files.archive_lines(pairs).write.text(at)
    return files.archive_turns(spark.read.text(at, wholetext=True)).drop("place")
