"""Columns with names that operators might use themselves: all survive, with their values, in every operator and stage."""

import pytest
from pyspark.sql import functions as F
from test_exact import documents

import corpus_pipeline
from memloom.llm import chat_format, decontamination, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, token_files, toxicity

NAMES = "items _id _key _doc _mark _hit score predicted kept contaminated g1 x0 m0 w00 a.b a`b _row _stat _told rank part piece fp n start own pooled path dir mark _words n_words".split()


@pytest.fixture(scope="module")
def odd(spark):
    texts = [f"some words of text {i} and {' '.join(f'w{i * 7 + k}' for k in range(60))}" + " idiot" * (i % 3 == 0) for i in range(24)] + ["", None]
    docs = documents(spark, texts)
    return docs.select("*", *[F.lit("mine").alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "some words of text 3")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def untouched(df, *replaced):
    names = [c for c in NAMES if c not in replaced]
    assert [c for c in df.columns if c in names] == names
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    assert {tuple(r) for r in df.select(*quoted).collect()} <= {("mine",) * len(names)}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, odd, at, name, stage):
    out = stage(spark, odd, at)
    assert out.columns == odd.columns
    untouched(out)


def test_operators(spark, odd, at, tmp_path):
    labels, bench = spark.read.parquet(f"{at}/labels.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    for op in (quality_classifier, toxicity):
        model = op.train(odd, labels)
        untouched(op.score(odd, model), "score", "predicted")
        assert op.accepted(odd, model).columns == odd.columns
    untouched(language_id.predict(odd, language_id.train(odd)), "score")
    untouched(decontamination.judge(odd, bench), "n_words", "contaminated")
    untouched(quality_rules.judge(odd), "n_words", "kept")
    untouched(near_dedup.keep_one(odd))
    assert near_dedup.classes(odd).count() == packing.pack(odd).select("doc_id").count() == 26
    token_files.write(odd, str(tmp_path / "ids"))
    assert token_files.read(spark, str(tmp_path / "ids")).count() == 26
    assert license_scan.scan(odd.withColumn("path", F.concat(F.lit("d/"), "doc_id"))).count() == 26
    turns = odd.withColumnsRenamed({"doc_id": "conv_id"}).withColumns({"turn": F.lit(1), "role": F.lit("user")})
    assert chat_format.render(turns).count() == 26


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, odd, at, name, stage):
    assert stage(spark, odd.limit(0), at).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_rows_that_repeat_an_id(spark, at, name, stage):
    """Clean documents that share an id and differ in text are rows of their own: none goes because of another, and none is doubled."""
    texts = [f"plain words of text {i} and {' '.join(f'v{i * 11 + k}' for k in range(60))}" for i in range(12)]
    docs = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 4, 5).otherwise(F.col("doc_id")).cast("long"))
    out = stage(spark, docs, at)
    kept = sorted((r["doc_id"], r["text"]) for r in out.collect())
    assert len(kept) == len(set(kept)) and set(kept) <= {(r["doc_id"], r["text"]) for r in docs.collect()}
    if name in ("near_dedup", "decontamination"):
        assert len(kept) == 12
