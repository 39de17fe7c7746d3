"""The queries of the training-data operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import chat_format, cross_polytope, decontamination, hard_negatives, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, spelling_variants, token_files, toxicity
from memloom.llm.common import held_out, scratch, table

WORD = decontamination.WORD


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt; one in 50 is a license file of its source's directory."""
    source, lang = F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown"))
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(source, F.lit("/LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(source, F.lit("/"), lang, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(table(spark, sf_dir, "documents").select(name.alias("path"), "text"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, scale=256)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling_variants.runs(table(spark, sf_dir, "documents"))
    words = runs.select(spelling_variants.slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return spelling_variants.forms(spelling_variants.vocabulary(words))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_simhash_near_dedup, op3_toxicity, op4_license_scan, op5_best_fit_packing, op6_language_id, op7_benchmark_decontamination, op8_chat_format, op9_token_files, op10_quality_rules, op11_hard_negatives, op12_nearest_neighbours, op13_spelling_variants)
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join(f"('{name}', '{word}', CAST({share!r} AS DOUBLE), CAST({idf!r} AS DOUBLE))" for name, word, share, idf in license_scan.weights())

ORACLE_SQL: dict[str, str] = {
    "op7_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[i:i + 12], ' ') AS gram, len(w[i:i + 12]) AS n
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
spot AS (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, spot.n AS n, item FROM spot JOIN g ON g.n = spot.n AND g.gram = array_to_string(spot.w[i:i + spot.n - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hit GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op4_license_scan": rf"""
WITH t(license, word, share, idf) AS (VALUES {_TEMPLATES}),
named AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, text FROM documents),
files AS (SELECT CASE WHEN doc_id % 50 = 0 THEN source || '/LICENSE-' || doc_id ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS path, text FROM named),
cut AS (SELECT path, string_split(text, chr(10)) AS parts FROM files),
lines AS (SELECT path, generate_subscripts(parts, 1) AS line, unnest(parts) AS said FROM cut),
said AS (SELECT path, line, unnest(regexp_extract_all(lower(said), '{license_scan._WORD}')) AS word FROM lines),
counts AS (SELECT path, line, word, count(*) AS n FROM said GROUP BY ALL),
idf AS (SELECT word, max(idf) AS idf FROM t GROUP BY word),
weighed AS (SELECT path, line, word, n * coalesce(idf, 1 + ln((1 + {len(license_scan.TEMPLATES)}) / 2.0)) AS x FROM counts LEFT JOIN idf USING (word)),
norms AS (SELECT path, line, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
scores AS (SELECT path, license, round(max(dot / norm), 6) AS score FROM (SELECT path, line, license, sum(x * share) AS dot FROM weighed JOIN t USING (word) GROUP BY ALL) JOIN norms USING (path, line) GROUP BY ALL),
own AS (SELECT path, license, score FROM scores WHERE score >= {license_scan.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
dirs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, score FROM own WHERE regexp_matches(path, '(^|/)LICENSE[^/]*$') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1)
SELECT f.path AS path, coalesce(o.license, a.license, b.license) AS license, coalesce(o.score, a.score, b.score) AS score,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN coalesce(a.license, b.license) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.license IS NULL THEN coalesce(a.dir, b.dir) END AS from_path
FROM files f LEFT JOIN own o USING (path) LEFT JOIN dirs a ON a.dir = regexp_replace(f.path, '/[^/]*$', '') LEFT JOIN dirs b ON b.dir = split_part(f.path, '/', 1)
""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id AS anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs),
r AS (SELECT doc_id, translate(run, '{spelling_variants.UPPER}', '{spelling_variants.LOWER}') AS run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{spelling_variants.LETTER}{{7,}}')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT run, k, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x, crcs FROM r, t),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substring(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])), 4294967295) AS h FROM x),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
v AS (SELECT DISTINCT word, i, substring(word, 1, i) || substring(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word AS word, b.word AS other FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON w.word = v.less UNION SELECT w.word, v.word FROM v JOIN w ON w.word = v.less),
best AS (SELECT near.word AS word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS best, max(w.n) AS best_n FROM near JOIN w ON w.word = other GROUP BY near.word),
f AS (SELECT w.word AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word AS word, f.form AS form, c.root AS root, f.n AS n, f.n_near AS n_near, f.form_n AS form_n FROM f JOIN (SELECT chain.word AS word, chain.root AS root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL) c ON c.word = f.word
""",
    "op8_chat_format": """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said FROM turns GROUP BY conv_id),
classes AS (SELECT said, min(conv_id) AS conv_id, count(*) AS copies FROM convs GROUP BY said),
kept AS (SELECT * FROM classes a WHERE NOT EXISTS (SELECT 1 FROM classes b WHERE len(b.said) > len(a.said) AND b.said[1:len(a.said)] = a.said))
SELECT conv_id, len(said) AS n_turns, copies,
       list_aggregate(list_transform(said, lambda x: '<|im_start|>' || coalesce(x.role, 'user') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM kept
""",
}
