"""Queries of the memory table, conversations, chunks, streams' batch twins and settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import routing, text
from memloom.operators import chunking, conversation, metadata, store
from memloom.plans.catalog import query, spread, table
from memloom.streaming import sse

#: documents as memories with tags from labels: quality 1 is keep, toxic 1 is bad; times count up by the minute.
MEMORIES = """memories AS (SELECT d.doc_id AS id, text, source AS collection, lang AS category,
  concat_ws(',', CASE WHEN quality = 1 THEN 'keep' END, CASE WHEN toxic = 1 THEN 'bad' END) AS tags,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  '{"n":' || n_chars || ',"lang":"' || lang || '"}' AS metadata FROM documents d LEFT JOIN labels l USING (doc_id))"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    base = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    tags = metadata.with_flag(metadata.with_flag(F.lit(""), "keep", F.col("quality") == 1), "bad", F.col("toxic") == 1)
    when = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("doc_id"))
    return base.select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("collection"), F.col("lang").alias("category"), tags.alias("tags"), text.iso_utc(when).alias("timestamp"),
        F.to_json(F.struct(F.col("n_chars").alias("n"), "lang")).alias("metadata"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("SELECT count(*) AS n FROM documents")
def count_memories(spark, sf_dir):
    return memories(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source AS collection FROM documents")
def collections_distinct(spark, sf_dir):
    return memories(spark, sf_dir).select("collection").distinct()


@query("SELECT doc_id AS id, source AS collection FROM documents WHERE source IN ('src1', 'src2')")
def collection_filter(spark, sf_dir):
    from memloom.operators.retrieval import in_collections

    return memories(spark, sf_dir).where(in_collections(["src1", "src2"])).select("id", "collection")


@query(f"WITH {MEMORIES} SELECT id, text, 0.0::DOUBLE AS score, metadata, timestamp FROM memories WHERE collection = 'src1' ORDER BY id")
def load_all_by_collection(spark, sf_dir):
    return memories(spark, sf_dir).where("collection = 'src1'").select("id", "text", F.lit(0.0).alias("score"), "metadata", "timestamp").orderBy("id")


@query(f"WITH {MEMORIES} SELECT id, tags FROM memories")
def tags_from_flags(spark, sf_dir):
    return memories(spark, sf_dir).select("id", "tags")


@query(f"WITH {MEMORIES} SELECT id, timestamp FROM memories WHERE collection = 'src0' AND category = 'en' AND tags ILIKE '%KEEP%' ORDER BY timestamp DESC, id LIMIT 20")
def metadata_search(spark, sf_dir):
    return metadata.search_by_metadata(memories(spark, sf_dir), {"collection": "src0", "category": "en"}, 20, tag="KEEP").select("id", "timestamp")


@query(f"WITH {MEMORIES} SELECT id FROM memories WHERE timestamp >= '2024-01-01T02:00:00Z' AND timestamp < '2024-01-01T10:00:00Z'")
def temporal_range(spark, sf_dir):
    return metadata.search_by_metadata(memories(spark, sf_dir), after="2024-01-01T02:00:00Z", before="2024-01-01T10:00:00Z").select("id")


@query(f"WITH {MEMORIES} SELECT id, tags FROM memories WHERE tags ILIKE '%BaD%'")
def tag_ilike(spark, sf_dir):
    return metadata.search_by_metadata(memories(spark, sf_dir), tag="BaD").select("id", "tags")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 3 AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
def metadata_json_equality(spark, sf_dir):
    return table(spark, sf_dir, "events").where(metadata.json_equals(F.col("props"), "k", 3)).select("event_id")


@query(
    """SELECT doc_id AS id, source AS collection, lang AS category, 'a,b' || CASE WHEN doc_id % 2 = 0 THEN ',keep' ELSE '' END AS tags, '{"n":' || n_chars || ',"o":{"lang":"' || lang || '","on":' || (doc_id % 2 = 0) || '}}' AS metadata,
'{"n":' || n_chars || ',"o":{"lang":"' || lang || '","on":' || (doc_id % 2 = 0) || '},"collection":"' || source || '","category":"' || lang || '","tags":"a,b' || CASE WHEN doc_id % 2 = 0 THEN ',keep' ELSE '' END || '"}' AS merged FROM documents"""
)
def metadata_split_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = F.to_json(F.struct(F.col("n_chars").alias("n"), F.struct("lang", (F.col("doc_id") % 2 == 0).alias("on")).alias("o"), F.col("source").alias("collection"), F.col("lang").alias("category"), F.array(F.lit("a"), F.lit("b")).alias("tags"), (F.col("doc_id") % 2 == 0).alias("keep")))
    split = metadata.split_metadata(docs.select(F.col("doc_id").alias("id"), packed.alias("metadata"))).drop("meta_timestamp")
    return metadata.merge_metadata(split.withColumn("m", F.col("metadata")), "m").withColumnRenamed("m", "merged")


@query("SELECT doc_id, replace('see /home/ann/' || source || ' and /home/ann/' || lang || ' in /home/ann', '/home/ann/', '~/') AS text FROM documents")
def path_normalize(spark, sf_dir):
    said = F.concat(F.lit("see /home/ann/"), "source", F.lit(" and /home/ann/"), "lang", F.lit(" in /home/ann"))
    return table(spark, sf_dir, "documents").select("doc_id", text.short_home(said, "/home/ann").alias("text"))


@query(
    """WITH ends AS (SELECT doc_id, text, list_filter(generate_series(1, 200), lambda n: strlen(substring(text, 1, n)) <= 200) AS fit FROM documents)
SELECT doc_id, CASE WHEN strlen(text) > 200 THEN substring(text, 1, len(fit)) || '...' ELSE text END AS preview FROM ends"""
)
def preview_200(spark, sf_dir):
    """200 bytes at most: of a text with longer characters fewer of them, and none that is cut in two."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(f"WITH {MEMORIES} SELECT id FROM memories WHERE NOT (id % 3 = 0 AND NOT contains(tags, 'keep'))")
def keep_protected_delete(spark, sf_dir):
    m = memories(spark, sf_dir)
    return store.delete(m, m.where("id % 3 = 0").select("id"))[0].select("id")


@query(f"WITH {MEMORIES} SELECT id AS memory_id, category AS token FROM memories WHERE NOT (id % 3 = 0 AND NOT contains(tags, 'keep'))")
def delete_cascade_postings(spark, sf_dir):
    m = memories(spark, sf_dir)
    deleted = store.delete(m, m.where("id % 3 = 0").select("id"))[1]
    return store.cascade(m.select(F.col("id").alias("memory_id"), F.col("category").alias("token")), deleted)


@query(f"WITH {MEMORIES} SELECT id FROM memories WHERE NOT (collection = 'src0' AND timestamp < '2024-01-01T12:00:00Z' AND NOT contains(tags, 'keep'))")
def retention_purge(spark, sf_dir):
    from datetime import datetime, timezone

    m = memories(spark, sf_dir).withColumn("collection", F.when(F.col("collection") == "src0", "conversation").otherwise(F.col("collection")))
    return store.purge(m, 12, datetime(2024, 1, 2, tzinfo=timezone.utc)).select("id")


@query(
    f"""WITH {MEMORIES} SELECT id, CASE WHEN id % 5 = 0 AND NOT contains(tags, 'keep') THEN 'new ' || id ELSE text END AS text, timestamp,
CASE WHEN id % 5 = 0 AND NOT contains(tags, 'keep') THEN 'memory' ELSE collection END AS collection FROM memories"""
)
def update_text(spark, sf_dir):
    m = memories(spark, sf_dir)
    changes = m.where("id % 5 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("text"), F.lit("{}").alias("metadata"))
    return store.update_text(m, changes).select("id", "text", "timestamp", "collection")


@query("SELECT 1000 + row_number() OVER (ORDER BY text, doc_id) AS id, text, 'memory' AS collection FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)")
def store_append(spark, sf_dir):
    batch = table(spark, sf_dir, "documents").select("text").distinct().withColumn("metadata", F.lit("{}"))
    return store.new_rows(batch, 1001).select("id", "text", "collection")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_version_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old, new = e.where("event_id % 2 = 0"), e
    return store.upsert(store.latest(old, "user_id", order="event_id"), store.latest(new, "user_id", order="event_id"), "user_id")


_PAIRS = r"""pairs AS (SELECT conv_id, turn, trim(text) AS user_text, CASE WHEN next_role = 'assistant' THEN trim(next_text) ELSE '' END AS assistant_text FROM
  (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def turn_pairing(spark, sf_dir):
    return conversation.pair_turns(turns(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, user_text AS user_part, assistant_text AS assistant_part FROM pairs")
def exchange_roundtrip(spark, sf_dir):
    joined = conversation.pair_turns(turns(spark, sf_dir)).select("conv_id", "turn", conversation.exchange(F.col("user_text"), F.col("assistant_text")).alias("x"))
    user, reply = conversation.exchange_parts(F.col("x"))
    return joined.select("conv_id", "turn", user.alias("user_part"), reply.alias("assistant_part"))


@query(
    f"WITH {_PAIRS} SELECT conv_id, string_agg('**User:** ' || user_text || chr(10) || chr(10) || '**Assistant:** ' || assistant_text || chr(10) || chr(10), '' ORDER BY turn) AS rendered FROM pairs GROUP BY conv_id"
)
def conversation_render(spark, sf_dir):
    return conversation.render(conversation.pair_turns(turns(spark, sf_dir)))


@query(
    """SELECT conv_id, turn, role FROM conversations WHERE role = 'system'
UNION ALL SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role <> 'system') WHERE r <= 4"""
)
def last_n_turns(spark, sf_dir):
    return conversation.last_turns(turns(spark, sf_dir), 2).select("conv_id", "turn", "role")


@query("SELECT conv_id, arg_max(text, turn) AS last_user FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return conversation.last_user_message(turns(spark, sf_dir))


@query(
    """SELECT conv_id, turn, before AS user_text, text AS assistant_text FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
WHERE role = 'assistant' AND before IS NOT NULL"""
)
def unsummarized_pairs(spark, sf_dir):
    return conversation.unsummarized(turns(spark, sf_dir))


@query(
    r"""SELECT conv_id, turn, n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND length(text) BETWEEN 10 AND 500
AND NOT contains(text, '<relevant-memories>') AND NOT (starts_with(text, '<') AND contains(text, '</'))
AND regexp_matches(text, '(?i)remember|zapamatuj|pamatuj|prefer|like|love|hate|want|need|my\s+\w+\s+is|is\s+my|i (always|never|usually)|important|decision|decided')) WHERE n <= 3"""
)
def auto_capture(spark, sf_dir):
    return conversation.captured(turns(spark, sf_dir), text.worth_capturing(F.col("text"))).select("conv_id", "turn", "n")


_MARKDOWN = "'# ' || lang || chr(10) || chr(10) || 'about  ' || source || chr(10) || chr(10) || '## ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("# "), "lang", F.lit("\n\nabout  "), "source", F.lit("\n\n## "), "source", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", made.alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_MARKDOWN}, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS cleaned FROM documents")
def clean_markdown(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", text.clean_markdown(F.col("text")).alias("cleaned"))


_PARAGRAPHS = f"""paras AS (SELECT doc_id, list_transform(list_filter(string_split_regex(regexp_replace({_MARKDOWN}, '^\\n+', ''), '\\n\\n+'), lambda p: p NOT IN ('', chr(10))), lambda p: regexp_replace(p, '[\\n\\r ]+$', '')) AS paragraphs FROM documents)"""


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, len(paragraphs) AS n, array_to_string(paragraphs, '|') AS said FROM paras")
def paragraph_split(spark, sf_dir):
    p = markdown(spark, sf_dir).select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("said"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, regexp_replace(line, '[\\r ]+$', '') AS body, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE regexp_replace(line, '[\\r]+', '', 'g') <> ''),
k AS (SELECT *, n % 7 AS m, (n // 7) AS round FROM p)
SELECT doc_id, CAST(4 * n - 1 AS INTEGER) AS place, CASE m WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 6 ELSE 3 END AS level,
CASE m WHEN 1 THEN 'h' || n WHEN 2 THEN 'h' || (n - 1) || ' » h' || n WHEN 3 THEN 'h' || (n - 2) || ' » h' || (n - 1) || ' » h' || n WHEN 4 THEN 'h' || (n - 3) || ' » h' || n
WHEN 5 THEN 'h' || (n - 4) || ' » h' || (n - 1) || ' » h' || n WHEN 6 THEN 'h' || (n - 5) || ' » h' || (n - 2) || ' » h' || n ELSE 'h' || (n - 6) || ' » h' || (n - 3) || ' » h' || n END AS section FROM k"""
)
def heading_stack(spark, sf_dir):
    """The headings open above each line of the documents, of levels that go up and down: 1, 2, 4, 2, 6, 3, 3 and again."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, "\r+", "") != "")
    level = lambda n: F.element_at(F.array(*[F.lit(x) for x in (3, 1, 2, 4, 2, 6, 3)]), n % 7 + 1)
    headed = F.transform(lines, lambda x, i: F.concat(F.repeat(F.lit("#"), level(i + 1)), F.lit(" h"), (i + 1).cast("string"), F.lit("\n\n"), F.concat(F.lit(". "), x)))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(headed, "\n\n").alias("text"))
    return chunking.sections(docs, "doc_id").select("doc_id", (2 * F.col("place") + 1).alias("place"), "level", "section")


_NN = "chr(10) || chr(10)"
_CLEANED = f"regexp_replace(regexp_replace({_MARKDOWN}, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', {_NN}, 'g')"
#: Paragraphs below the first heading, then those below both, taken one by one: a chunk ends before the paragraph at which it has 300 bytes.
_CHUNKED = f"""WITH RECURSIVE pl AS (SELECT doc_id, lang, source,
  list_transform(list_filter(string_split_regex(regexp_replace({_CLEANED}, '^\\n+', ''), '\\n\\n+'), lambda p: p NOT IN ('', chr(10))), lambda p: regexp_replace(p, '[\\n\\r ]+$', '')) AS ps FROM documents),
b AS (SELECT doc_id, 1 AS i, ps[2] AS body, '# ' || lang AS block, lang AS section FROM pl
  UNION ALL SELECT doc_id, 1 + generate_subscripts(ps[4:], 1), unnest(ps[4:]), '# ' || lang || {_NN} || '## ' || source, lang || ' » ' || source FROM pl),
run AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS now, '' AS section, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS VARCHAR) AS done_section FROM pl WHERE ps IS NOT NULL
  UNION ALL SELECT doc_id, CAST(i AS BIGINT), CASE WHEN base = '' THEN added ELSE base || {_NN} || added END, section, done, done_section FROM (
    SELECT *, CASE WHEN base = '' OR section <> before THEN block || {_NN} || body ELSE body END AS added FROM (
      SELECT r.doc_id AS doc_id, r.i + 1 AS i, b.body AS body, b.block AS block, b.section AS section, r.section AS before, CASE WHEN strlen(r.now) >= 300 THEN '' ELSE r.now END AS base,
        CASE WHEN strlen(r.now) >= 300 THEN r.now END AS done, CASE WHEN strlen(r.now) >= 300 THEN r.section END AS done_section FROM run r JOIN b ON b.doc_id = r.doc_id AND b.i = r.i + 1))),
chunked AS (SELECT doc_id, i, done AS chunk_text, done_section AS section FROM run WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, max(i) + 1, arg_max(now, i), arg_max(section, i) FROM run GROUP BY doc_id HAVING arg_max(now, i) <> ''),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS chunk, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, chunk_text, section FROM chunked)"""


@query(f"{_CHUNKED} SELECT doc_id, chunk, total_chunks, chunk_text, section FROM chunks")
def chunk_markdown(spark, sf_dir):
    return chunking.chunk_rows(markdown(spark, sf_dir))


@query(f"{_CHUNKED} SELECT doc_id, chunk, total_chunks FROM chunks")
def chunk_ordinals(spark, sf_dir):
    return chunking.chunk_rows(markdown(spark, sf_dir)).select("doc_id", "chunk", "total_chunks")


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS s FROM events),
b AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 600 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session_no FROM b)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(s) AS session_start, max(s) AS session_end, count(*) AS n_events FROM n GROUP BY user_id, session_no"""
)
def idle_sessions(spark, sf_dir):
    return conversation.idle_sessions(table(spark, sf_dir, "events"))


@query("SELECT c_custkey AS user_id, c_name AS username, o_orderkey AS token, strftime(o_orderdate, '%Y-%m-%d') AS expires FROM customer JOIN orders ON c_custkey = o_custkey WHERE strftime(o_orderdate, '%Y-%m-%d') > '1997-01-01'")
def web_session_join(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    live = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("expires"))
    return store.signed_in(users, live, "1997-01-01").select(F.col("id").alias("user_id"), "username", "token", "expires")


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as token streams: an event for each turn, then the end."""
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    each = turns(spark, sf_dir).select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), said, F.lit("\n\n")).alias("chunk"))
    ends = each.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).withColumn("chunk", F.lit("data: [DONE]\n\n"))
    return each.unionByName(ends)


@query("SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text, TRUE AS done FROM conversations GROUP BY conv_id")
def sse_accumulate(spark, sf_dir):
    return sse.accumulate(stream_chunks(spark, sf_dir))


@query("SELECT conv_id, turn, text AS content FROM conversations")
def json_path_extract(spark, sf_dir):
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    return turns(spark, sf_dir).select("conv_id", "turn", routing.string_at(body, "choices[0].message.content").alias("content"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS delta FROM conversations")
def delta_filter(spark, sf_dir):
    kind = F.when(F.col("turn") % 2 == 0, "content_block_delta").otherwise("ping")
    event = F.to_json(F.struct(kind.alias("type"), F.struct("text").alias("delta")))
    return turns(spark, sf_dir).select("conv_id", "turn", sse.delta_of(event, "delta.text", "type", "content_block_delta").alias("delta"))


@query("SELECT c_custkey, sha256(c_name) AS token_hash FROM customer")
def sha256_token(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.token_hash(F.col("c_name")).alias("token_hash"))


@query("SELECT p_partkey, CASE WHEN p_name GLOB 'b*' OR p_name GLOB '*green*' THEN 'first' WHEN p_name GLOB 'b*' OR p_name GLOB '?e*' THEN 'second' ELSE 'last' END AS endpoint FROM part")
def glob_route(spark, sf_dir):
    ends = spark.createDataFrame([(0, "first", "b*, *green*"), (1, "second", "b*,?e*"), (2, "last", "none")], "ord int, name string, models string")
    asked = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("model"))
    return routing.route(asked, ends).select("p_partkey", "endpoint")


@query("SELECT p_partkey, CASE WHEN p_size - 5 <= 0 OR p_size - 5 > 20 THEN 20 ELSE p_size - 5 END AS clamped FROM part")
def clamp_ceiling(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", routing.clamped(F.col("p_size") - 5, 20).alias("clamped"))


@query("SELECT p_partkey, CASE WHEN p_size * 1000 BETWEEN 1 AND 32767 THEN least(greatest(500, CAST(floor(p_size * 1000 * 4.0 * 25 / 100) AS INTEGER)), 20000) ELSE 20000 END AS budget FROM part")
def persona_budget(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", routing.persona_budget(F.col("p_size") * 1000, 25, 20000).alias("budget"))


@query(
    r"""WITH f AS (SELECT source, doc_id, strlen(regexp_replace(text, '[ \t\r\n]+$', '')) AS n FROM documents WHERE regexp_replace(text, '[ \t\r\n]+$', '') <> ''),
r AS (SELECT *, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8 * (row_number() OVER w - 1) AS before FROM f WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
e AS (SELECT *, sum(CASE WHEN n <= 40000 - before THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id) AS ended FROM r)
SELECT source, doc_id, CAST(n AS INTEGER) AS n FROM e WHERE ended = 0"""
)
def persona_budget_prefix(spark, sf_dir):
    """The documents of each source that fit a budget whole, up to the first that doesn't; these have no paragraphs to cut that one at."""
    from memloom.operators.context import within_budget

    files = table(spark, sf_dir, "documents").select("source", "doc_id", "text", F.lit("file").alias("label"))
    return within_budget(files, 40000, "source", "doc_id").select("source", "doc_id", F.octet_length("section").alias("n"))


@query(f"WITH {MEMORIES} SELECT id FROM memories WHERE category = 'en' AND collection <> 'src0' AND date_diff('second', CAST(timestamp AS TIMESTAMP), TIMESTAMP '2024-01-01 10:00:30') // 60 > 5")
def orphaned_turns(spark, sf_dir):
    """Stored chat turns that were never summarized: English memories stand for them, source src0 for session mode."""
    mode = F.when(F.col("collection") == "src0", "session").otherwise("true")
    made = F.to_json(F.struct(F.lit("chat").alias("source"), mode.alias("mode")))
    m = memories(spark, sf_dir).withColumn("metadata", made).withColumn("category", F.when(F.col("category") == "en", "conversation"))
    return conversation.orphans(m, "2024-01-01T10:00:30Z").select("id")


@query("SELECT event_id FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'")
def turns_in_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), text.iso_utc(F.col("ts").cast("timestamp")).alias("timestamp"))
    return conversation.filter_turns(e, 7, "2024-01-02", "2024-01-20").select("event_id")


@query(
    f"""WITH {_PAIRS} SELECT '=== ' || turn || '  [web:' || substring('session-' || conv_id, 1, 8) || '] ===' || chr(10) || 'User: ' || user_text ||
CASE WHEN assistant_text <> '' THEN chr(10) || chr(10) || 'Assistant: ' || assistant_text ELSE '' END || chr(10) AS value FROM pairs"""
)
def archive_blocks(spark, sf_dir):
    from memloom.sources.files import archive_lines

    pairs = conversation.pair_turns(turns(spark, sf_dir)).withColumns({"session_id": F.concat(F.lit("session-"), F.col("conv_id").cast("string")), "source": F.lit("web"), "timestamp": F.col("turn").cast("string")})
    return archive_lines(pairs)


@query("SELECT conv_id, turn, trim(text) || chr(10) || chr(10) || 'more' AS said FROM conversations WHERE trim(text) <> ''")
def content_blocks(spark, sf_dir):
    from memloom.sources.files import content_text

    block = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    content = F.to_json(F.array(block("text", F.trim("text")), block("image", F.lit("no")), block("text", F.lit(" ")), block("text", F.lit("more"))))
    return turns(spark, sf_dir).where(F.trim("text") != "").select("conv_id", "turn", content_text(content).alias("said"))


@query("SELECT c_custkey, replace(replace(rtrim(to_base64(CAST(c_name AS BLOB)), '='), '+', '-'), '/', '_') AS token FROM customer")
def base64url_token(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.base64url(F.encode("c_name", "UTF-8")).alias("token"))


@query("SELECT page_id, url LIKE '%localhost%' OR url LIKE '%127.0.0.%' OR url LIKE '%192.168.%' OR url LIKE '%10.%' OR url LIKE '%0.0.0.0%' AS is_local FROM pages")
def local_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", routing.is_local(F.col("url")).alias("is_local"))


@query("SELECT conv_id, len(list_filter(list(role), lambda r: r = 'system')) AS n_system, len(list_filter(list(role), lambda r: r <> 'system')) AS n_messages FROM conversations GROUP BY conv_id")
def request_bodies(spark, sf_dir):
    """Request bodies of the second kind, which hoists system messages, counted back from their JSON."""
    sent = F.array_sort(F.collect_list(F.struct("turn", "role", F.lit("x").alias("content"))))
    body = turns(spark, sf_dir).groupBy("conv_id").agg(sent.alias("m")).select("conv_id", routing.request_body(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), F.lit("model"), "anthropic").alias("j"))
    system = F.coalesce(F.size(F.split(F.get_json_object("j", "$.system"), "\n\n")), F.lit(0))
    return body.select("conv_id", F.when(F.get_json_object("j", "$.system").isNull(), 0).otherwise(system).cast("long").alias("n_system"), F.json_array_length(F.get_json_object("j", "$.messages")).cast("long").alias("n_messages"))


@query(f"WITH {MEMORIES} SELECT id, collection FROM memories QUALIFY row_number() OVER (PARTITION BY collection ORDER BY timestamp DESC, id DESC) <= 5")
def retention_by_count(spark, sf_dir):
    from memloom.operators.context import newest

    return newest(memories(spark, sf_dir), 5).select("id", "collection")


@query(
    rf"""WITH f AS (SELECT source AS session, doc_id AS ord, regexp_replace({_MARKDOWN}, '[ \t\r\n]+$', '') AS t FROM documents),
r AS (SELECT *, strlen(t) AS n, coalesce(sum(strlen(t)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8 * (row_number() OVER w - 1) AS before FROM f WHERE t <> '' WINDOW w AS (PARTITION BY session ORDER BY ord)),
e AS (SELECT *, 20000 - before AS room, n <= 20000 - before AS fits, sum(CASE WHEN n <= 20000 - before THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ord) AS bad FROM r),
p AS (SELECT session, ord, room, generate_subscripts(ps, 1) AS k, unnest(ps) AS p FROM (SELECT *, list_filter(string_split_regex(t, '\n\n+'), lambda x: x <> '') AS ps FROM e WHERE bad = 1 AND NOT fits)),
c AS (SELECT *, sum(strlen(p)) OVER (PARTITION BY session, ord ORDER BY k) + 2 * greatest(k - 1, 1) > room AS over FROM p),
g AS (SELECT session, ord, string_agg(p, chr(10) || chr(10) ORDER BY k) AS kept FROM (SELECT *, bool_or(over) OVER (PARTITION BY session, ord ORDER BY k) AS ended FROM c) WHERE NOT ended GROUP BY ALL)
SELECT session, ord, t AS section FROM e WHERE bad = 0
UNION ALL SELECT session, ord, kept || chr(10) || chr(10) || '[... file truncated ...]' FROM g"""
)
def budgeted_sections(spark, sf_dir):
    """Documents of each source as files, while they fit 20,000 bytes; the first that doesn't is cut at a paragraph."""
    from memloom.operators.context import within_budget

    files = markdown(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("session")), "doc_id")
    return within_budget(files.withColumn("ord", F.col("doc_id")).withColumn("label", F.lit("file")), 20000)


@query()
def session_summaries(spark, sf_dir):
    """Conversations rendered, then summarized without a model."""
    from memloom.operators.context import summarizer

    said = conversation.render(conversation.pair_turns(turns(spark, sf_dir)))
    return said.select("conv_id", summarizer()(F.col("rendered")).alias("summary"))


@query(
    """SELECT doc_id AS id, vec_id IS NULL AS was_missing, CASE WHEN vec_id IS NULL THEN 384 ELSE len(embedding) END AS dims,
CASE WHEN vec_id IS NULL THEN 1.0 ELSE round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) END AS size FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""
)
def backfill_embeddings(spark, sf_dir):
    """Rows without an embedding get one of unit length; the others keep theirs."""
    from memloom.functions.embedding import embedder

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    m = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left").withColumn("was_missing", F.col("embedding").isNull())
    size = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return store.backfill(m, embedder()).select("id", "was_missing", F.size("embedding").alias("dims"), F.round(size, 4).alias("size"))


@query("SELECT user_id, session_start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS session_start FROM events) GROUP BY ALL")
def usage_by_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("session_start")).agg(F.count("*").alias("n"))


@query("SELECT conv_id AS stream_id, turn AS place, text AS delta, FALSE AS stopped FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, '', TRUE FROM conversations GROUP BY conv_id")
def sse_lines(spark, sf_dir):
    """Events of one line each, read line by line: their places are those of the turns."""
    lines = stream_chunks(spark, sf_dir).withColumn("chunk", F.replace("chunk", F.lit("\n\n"), F.lit("\n")))
    return sse.line_deltas(lines).select("stream_id", F.col("place").cast("long").alias("place"), "delta", "stopped")


@query("SELECT conv_id AS session_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def session_restore(spark, sf_dir):
    """Conversations stored as a JSON array of messages, and back."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    stored = turns(spark, sf_dir).groupBy(F.col("conv_id").alias("session_id")).agg(F.to_json(m).alias("messages"))
    return conversation.restored_turns(stored).select("session_id", F.col("turn").cast("long").alias("turn"), "role", "text")


@query("SELECT count(*) AS corpus_size, count(*) FILTER (source IN ('src1', 'src2')) AS filtered_size FROM documents")
def corpus_sizes(spark, sf_dir):
    from memloom.operators import retrieval

    return retrieval.corpus_sizes(memories(spark, sf_dir), ["src1", "src2"])


@query("SELECT c_custkey, '/home/ann/' || c_name AS path, strftime(TIMESTAMP '2024-01-01' + to_seconds(86400 + CAST(c_custkey AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS expires FROM customer")
def home_and_expiry(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.with_home(F.concat(F.lit("~/"), "c_name"), "/home/ann").alias("path"), text.expires(F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey"))).alias("expires"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x)) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS total FROM embeddings")
def mean_pooling(spark, sf_dir):
    """Three token vectors of which the mask leaves two, the embedding and its double: pooled, the embedding's direction."""
    from memloom.operators import retrieval

    e = table(spark, sf_dir, "embeddings")
    tokens = F.array(F.col("embedding"), F.transform("embedding", lambda x: F.lit(9.0).cast("float")), F.transform("embedding", lambda x: (2 * x).cast("float")))
    pooled = e.select("vec_id", retrieval.mean_pooled(tokens, F.array(F.lit(1), F.lit(0), F.lit(1))).alias("p"))
    return pooled.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"))
