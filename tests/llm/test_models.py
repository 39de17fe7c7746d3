"""Operators that learn: held-out accuracy, defined results of odd rows; and the pipeline's stages against brute force."""

import random
import tracemalloc
import zlib
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exact import DOC, LONG, components, documents, fingerprint, ids_of, judged, odd_documents

import corpus_pipeline
from memloom.llm import common, language_id, quality_classifier, toxicity
from memloom.llm.common import held_out

SYLLABLES = {"en": "th er on an re in ed nd ha at".split(), "de": "sch ung en ein ich ver keit ge ß ü".split(), "fr": "eau ou ai eux tre é è que oi ment".split()}
INSULTS = ["idiot", "scumbag", "worthless", "moronic"]


def prose(rng, lang="en", n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def auc(rows, label):
    score = {r["doc_id"]: r["score"] for r in rows}
    pos, neg = [score[i] for i in label if label[i] and is_held(i)], [score[i] for i in label if not label[i] and is_held(i)]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    texts, quality, toxic = [], {}, {}
    for i in range(400):
        words = prose(rng).split()
        quality[i], toxic[i] = int(i % 4 != 0), int(i % 5 == 0)
        if toxic[i]:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        texts.append(" ".join(w + "***" * (not quality[i]) for w in words))
    labels = spark.createDataFrame([(i, quality[i], toxic[i]) for i in quality], "doc_id long, quality int, toxic int")
    return documents(spark, texts).cache(), labels.cache(), quality, toxic


def test_held_out(spark):
    df = spark.range(50).select(F.col("id"), held_out(F.col("id")).alias("h"))
    assert [r["h"] for r in df.orderBy("id").collect()] == [is_held(i) for i in range(50)]
    assert spark.sql("select cast(null as long) as i").select(held_out(F.col("i"))).head()[0] is False


def test_quality(labelled):
    docs, labels, quality, _ = labelled
    got = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert auc(got, quality) > 0.99
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_folded_model_is_the_softmax():
    rng = np.random.default_rng(0)
    texts = ["some words here", "other words, there!!", "", "a a a"] * 5
    rows = [(i, s, k % 2) for k, (i, s) in enumerate(quality_classifier.counted(texts))]
    m = quality_classifier.fit(rows, quality_classifier.Training(epochs=2))
    for t, (ids, share, _) in zip(texts, rows, strict=True):
        assert m.score([t])[0] == pytest.approx(1 / (1 + np.exp(-(float(share @ m.logit[ids]) + m.bias))), abs=1e-5)
    assert m.score(texts) == pytest.approx([m.score([t])[0] for t in texts]) and rng


def test_scores_are_the_softmax_of_averaged_vectors():
    """Each document's vectors are averaged and put through the output layer one by one, without folding."""
    texts = [f"word{i % 3} and word{i % 5} {'xyz ' * (i % 4)}" for i in range(40)]
    rows = [(i, s, k % 2) for k, (i, s) in enumerate(quality_classifier.counted(texts))]
    how = quality_classifier.Training(epochs=3)
    table, out, bias = quality_classifier.learned(rows, how)
    got = quality_classifier.fit(rows, how).score(texts)
    for score, (ids, share, _) in zip(got, rows, strict=True):
        mean = np.zeros(how.dims)
        for b, s in zip(ids, share, strict=True):
            mean += s * table[b].astype(float)
        z = [sum(mean[d] * float(out[d, y]) for d in range(how.dims)) + float(bias[y]) for y in (0, 1)]
        assert score == pytest.approx(np.exp(z[1]) / (np.exp(z[0]) + np.exp(z[1])), abs=1e-4)


def test_samples_are_bounded(spark):
    """One id in 10,000 rows, rows that repeat, long texts: never more rows or bytes than asked for."""
    rows = [(1, f"text {i % 5000}") for i in range(10_000)] + [(i, "x" * 1000) for i in range(2, 60)] + [(1000, None), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"t": F.lit("clash"), "bytes": F.lit("clash")})
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in [*range(1, 60), 1000]], "doc_id long, quality int, toxic int")
    got = common.sampled(docs, labels, "quality", {0: 10, 1: 300}, 1 << 20).collect()
    assert len(got) <= 310 and sum(r["y"] == 0 for r in got) == 10 and len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    assert not any(is_held(r["doc_id"]) for r in got)
    few = common.sampled(docs, labels, "quality", {0: 10_000, 1: 10_000}, 20_000).collect()
    assert sum(len(r["text"]) for r in few) <= 20_000 and sum(len(r["text"]) for r in few if r["y"] == 0) > 8000
    quality_classifier.train(docs, labels, quality_classifier.Training(sample=100))
    toxicity.train(docs, labels, toxicity.Training(sample=100))


def test_toxicity(labelled):
    docs, labels, _, toxic = labelled
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert auc(got, toxic) > 0.99
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in got if is_held(r["doc_id"])]) > 0.95
    plain, broken, spaced, clean = model.margins(["an worthless here", "an worth-less here", "an w o r t h l e s s here", "an ananed here"])
    assert plain == pytest.approx(spaced) and plain == pytest.approx(broken) and plain > clean


def test_inserted_characters_and_lookalikes(labelled):
    """Insults that training never saw broken, in clean texts: signs, letters and spaces within; words that only look like insults."""
    docs, labels, _, toxic = labelled
    rng, model = random.Random(4), toxicity.train(docs, labels)
    clean = [r["text"] for r in docs.collect() if not toxic[r["doc_id"]] and is_held(r["doc_id"])]

    def flagged(word):
        said = [t.split() for t in clean]
        for words in said:
            words.insert(rng.randrange(len(words) + 1), word(rng))
        return np.mean(model.score([" ".join(w) for w in said]) >= 0.3)

    def broken(signs):
        def make(r):
            w = r.choice(INSULTS)
            k = r.randrange(2, len(w) - 1)
            return w[:k] + r.choice(signs) + w[k:]

        return make

    assert np.mean(model.score(clean) >= 0.3) <= 0.05
    assert flagged(broken("xqjz")) >= 0.8 and flagged(broken("-.*_")) >= 0.8 and flagged(lambda r: " ".join(r.choice(INSULTS))) >= 0.8
    assert flagged(lambda r: r.choice("idiom scuba worthwhile moral worth stand idea".split())) <= 0.05


def test_sentences_are_the_units():
    def show(spans):
        return ["".join("^" if c == toxicity.MARK else chr(96 + c) for c in s) for s in spans]

    got = toxicity.sentences(["Go a-way, now! I d i o t you.\nx", None, " -- ", "v 1.0 is"])
    assert [[show(s) for s in doc] for doc in got] == [[["^go^", "^away^", "^go^away^", "^now^", "^away^now^"], ["^idiot^", "^you^", "^idiot^you^"], ["^x^"]], [], [], [["^v^", "^io^", "^v^io^", "^is^", "^io^is^"]]]


def subsequences(span):
    out = {}
    for a, b in toxicity.STEPS:
        for i in range(len(span) - a - b):
            key = (span[i], span[i + a], span[i + a + b])
            out[key] = out.get(key, 0) + toxicity.DECAY ** (a + b + 1)
    return out


def length(span):
    return sum(v * v for v in subsequences(span).values()) ** 0.5


def coded(*words):
    mark = bytes([toxicity.MARK])
    return mark + mark.join(bytes(ord(c) - 96 for c in w) for w in words) + mark


def test_string_kernel_by_brute_force():
    spans = [coded("idiot"), coded("idxiot"), coded("go", "away"), coded("stoat"), coded("a")]
    got = toxicity.kernel(spans, toxicity.Landmarks.of(spans))
    for i, x in enumerate(spans):
        for j, y in enumerate(spans):
            b = subsequences(y)
            want = sum(v * b.get(k, 0) for k, v in subsequences(x).items()) / length(x) / length(y)
            assert got[i, j] == pytest.approx(want, abs=1e-5)


def test_folded_machine_by_brute_force():
    """Margins of sentences, from weights for each subsequence, without vectors: the best of words, pairs, and words without one letter."""
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, toxicity.FEATURES).astype(np.float32)
    for k in range(3):
        weights[np.arange(toxicity.FEATURES) // toxicity.LETTERS**k % toxicity.LETTERS == 0] = 0
    model = toxicity.Model(weights, 0.25)

    def margin(span):
        total = sum(v * float(weights[(x * toxicity.LETTERS + y) * toxicity.LETTERS + z]) for (x, y, z), v in subsequences(span).items())
        rough = total / float(toxicity.norm(len(span))) + 0.25
        return total / length(span) + 0.25 if rough > toxicity.NEAR else rough

    texts = ["go away idiot! you there, all.", "x", "some words without end and a long one " * 3]
    for text, got in zip(texts, model.margins(texts), strict=True):
        every = []
        for part in text.replace(",", "").replace("!", ".").replace(". ", ".").split("."):
            words = part.split()
            for w, after in zip(words, [*words[1:], None], strict=False):
                every.append(margin(coded(w)))
                if after:
                    every.append(margin(coded(w, after)))
                if every and len(w) > 4 and margin(coded(w)) > toxicity.NEAR:
                    every += [margin(coded(w[:k] + w[k + 1 :])) - toxicity.MENDED for k in range(1, len(w) - 1)]
        assert got == pytest.approx(max(every), abs=1e-4)


def test_language(spark):
    rng = random.Random(3)
    langs = ["en", "de", "fr"]
    rows = [(i, prose(rng, langs[i % 3], 30), None if i % 17 == 0 else langs[i % 3], "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    model = language_id.train(docs)
    got = language_id.predict(docs.select("doc_id", "text"), model).collect()
    assert np.mean([r["lang_pred"] == langs[r["doc_id"] % 3] for r in got if is_held(r["doc_id"])]) > 0.97
    assert model.names == ("de", "en", "fr")
    names, scores = model.predict([None, "", "12 ??", "the", "ß"])
    assert names[:3] == ["und"] * 3 and set(names[3:]) <= {"de", "en", "fr"} and all(0 <= s <= 1 for s in scores)
    assert language_id.train(docs.limit(0)).predict(["words"])[0] == ["und"]


def tree_of(texts, **how):
    count = {}
    for t in texts:
        data = language_id._GAP + t.encode()
        for i in range(language_id.ORDER, len(data)):
            w = int.from_bytes(data[i - language_id.ORDER : i + 1], "big")
            count[w] = count.get(w, 0) + 1
    strings = sorted(count)
    return language_id.Tree.of(np.array(strings, np.uint64), np.array([count[w] for w in strings], float), language_id.Training(**how))


def ppm(texts, least):
    """P(byte | context) by recursion over dictionaries."""
    seen = {}
    for t in texts:
        data = language_id._GAP + t.encode()
        for i in range(language_id.ORDER, len(data)):
            for k in range(language_id.ORDER + 1):
                after = seen.setdefault(data[i - k : i], {})
                after[data[i]] = after.get(data[i], 0) + 1

    def p(context, x):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        after = seen.get(context, {})
        d, t = sum(after.values()), len(after)
        if context and d < least:
            return p(shorter, x)
        if x in after:
            return after[x] / (d + t)
        return t / (d + t) * p(shorter, x) / (1 - sum(p(shorter, s) for s in after))

    return p


def test_code_lengths_by_brute_force():
    en, de = ["the cat sat on the mat and ate", "a cat that sat"], ["die katze saß auf der matte", "der kater aß"]
    block = language_id.Block(["de", "en"], [tree_of(de, least=2), tree_of(en, least=2)])
    for text in ("the cat saß here", "x", "ж", ""):
        data = language_id._GAP + text.encode()
        want = [-sum(np.log2(p(data[i - language_id.ORDER : i], data[i])) for i in range(language_id.ORDER, len(data))) for p in (ppm(de, 2), ppm(en, 2))]
        assert block.measure([text])[0] == pytest.approx(want, rel=1e-5, abs=1e-6)
    assert block.measure(["the cat", None, "saß " * 300]).shape == (3, 2)


def test_probabilities_sum_to_one():
    block = language_id.Block(["en", "ru"], [tree_of(["the cat sat on the mat"] * 3, least=1), tree_of(["кот сидел на окне"], least=2)])
    contexts = language_id.windows(np.frombuffer("    the cat кот z".encode(), np.uint8)) & ~np.uint64(255)
    every = (contexts[:, None] | np.arange(256, dtype=np.uint64)).reshape(-1)
    assert np.exp2(-block.exact(every).astype(float)).reshape(-1, 256, 2).sum(1) == pytest.approx(1, abs=1e-5)


def test_trees_are_held_to_a_size():
    big = tree_of(["some words of a text, and other words of it"] * 4, nodes=60)
    assert 0 < len(big.keys) <= 256 + 60 and len(tree_of(["ab"]).keys)


SCRIPTS = {"el": "και το να τα της με που από για ένα", "ru": "и не на что как это все так его был", "uk": "і не на що як це все так його був", "zh": "的 一是 不了 人我 在有 他这 中大 来上 个国 到说", "en": "the of and to in is that it was he"}


def test_other_scripts_and_blocks(spark, monkeypatch):
    """Languages that share their script, and ones that don't; the same results with a block for each."""
    rng = random.Random(8)
    langs = list(SCRIPTS)
    texts = [" ".join(rng.choice(SCRIPTS[langs[i % 5]].split()) for _ in range(12)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, langs[i % 5], "s", 0) for i, t in enumerate(texts)], DOC)
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == langs[i % 5] for i in got if is_held(i)]) > 0.97
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 1)
    split = language_id.train(docs)
    assert len(split.blocks) == 5 and split.names == tuple(sorted(langs))
    for r in language_id.predict(docs, split).collect():
        assert r["lang_pred"] == got[r["doc_id"]]["lang_pred"] and r["score"] == pytest.approx(got[r["doc_id"]]["score"], abs=1e-6)
    assert split.predict(texts[:9])[0] == model.predict(texts[:9])[0]


def test_models_odd_rows(spark, labelled):
    docs, labels, *_ = labelled
    odd = odd_documents(spark).withColumn("predicted", F.lit("mine")).withColumn("lang_pred", F.lit(1))
    for op, model in ((quality_classifier, quality_classifier.train(docs, labels)), (toxicity, toxicity.train(docs, labels))):
        got = op.score(odd, model)
        assert got.count() == 8 and dict(got.dtypes)["score"] == "double" and len(got.columns) == len(odd.columns)
        by = {}
        for r in got.collect():
            by.setdefault(r["text"] or "", set()).add((r["score"], r["predicted"]))
        assert all(len(v) == 1 for v in by.values())
        assert op.score(odd.limit(0), model).count() == 0
        blind = op.train(odd, labels.where("doc_id < 0"))
        assert op.score(odd, blind).select("score").distinct().count() == 1
        assert op.train(odd, labels.unionByName(spark.createDataFrame([(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))) is not None
    told = language_id.predict(odd, language_id.train(odd))
    assert told.count() == 8 and {r["lang_pred"] for r in told.collect()} == {"und"}


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    items = [(k, prose(rng, n=30)) for k in range(3)]
    texts, quality, toxic = [], {}, {}
    for i in range(160):
        words = prose(rng, n=rng.randint(40, 120)).split()
        quality[i], toxic[i] = int(i % 4 != 0), int(i % 5 == 0)
        if toxic[i]:
            words[10:10] = [rng.choice(INSULTS)]
        if i % 9 == 0:
            words += items[i % 3][1].split()
        texts.append(" ".join(w + "***" * (not quality[i]) for w in words))
        if i % 7 == 0:
            texts[i] = texts[i - 1]
            quality[i], toxic[i] = quality[max(0, i - 1)], toxic[max(0, i - 1)]
    at = str(tmp_path)
    documents(spark, texts).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, quality[i], toxic[i]) for i in quality], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), [list(range(160))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        assert docs.columns == before
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    first, good, mild, single, clean = kept
    assert np.mean([(i in good) == quality[i] for i in first]) > 0.97
    assert np.mean([(i in mild) == (not toxic[i]) for i in good]) > 0.95
    assert single == [mild[k] for k in sorted(set(components([fingerprint(texts[i]) for i in mild])))]
    bad = {r[0] for r in judged([(i, texts[i]) for i in single], items) if r[5]}
    assert bad and clean == [i for i in single if i not in bad]
    out = corpus_pipeline.run(spark, at).collect()
    assert {r["doc_id"] for r in out} == set(clean) and sum(r["length"] for r in out) == sum(len(ids_of(texts[i])) for i in clean)


def test_long_text_is_scored_whole(labelled):
    docs, labels, *_ = labelled
    model = toxicity.train(docs, labels)
    assert model.margins([LONG + " idiot"])[0] > model.margins([LONG])[0]


def test_further_sentences_add_to_a_score(labelled):
    docs, labels, *_ = labelled
    model = toxicity.train(docs, labels)
    clean = "an ananed here."
    one, two, none = model.evidence([f"{clean} idiot. {clean}", f"{clean} idiot. scumbag.", ""])
    assert two[2] > one[2] > 0 and none.tolist() == [toxicity.WORDLESS, 0, 0, 0] and one[3] == two[3]


def test_toxicity_takes_ids_of_any_kind(spark, labelled):
    docs, labels, *_ = labelled
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    marked = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for op in (toxicity, quality_classifier):
        got = op.score(named, op.train(named, marked))
        assert got.count() == docs.count() and got.select("score").distinct().count() > 2


def test_packed_rows_are_the_counts():
    """What the driver gets of the sampled rows is small, and the same counts and the same model come of it."""
    texts = [f"word{i % 7} and word{i % 5} {'xyz ' * (i % 4)} grüße number {i * i}, and so on" * 9 for i in range(30)] + ["", None, "a"]
    rows = [(i, s, k % 2) for k, (i, s) in enumerate(quality_classifier.counted(texts))]
    raw = list(quality_classifier.packed(texts))
    got = quality_classifier.Rows([(p, k % 2) for k, p in enumerate(raw)])
    assert sum(map(len, raw)) < sum(8 * len(i) for i, _, _ in rows) / 2
    for (i, s, y), (j, t, z) in zip(rows, got, strict=True):
        assert i.dtype == j.dtype and s.dtype == t.dtype and i.tolist() == j.tolist() and s.tolist() == t.tolist() and y == z
    how = quality_classifier.Training(epochs=2)
    assert (quality_classifier.fit(rows, how).logit == quality_classifier.fit(got, how).logit).all()


def test_training_holds_few_spans():
    """The memory that a machine's training takes beyond what it counts; a document's spans are made anew, in the same order."""
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 8))) for _ in range(1000)) + "." for _ in range(60)]
    assert [list(d) for d in map(toxicity.Spoken, texts[:3])] == toxicity.sentences(texts[:3]) and len(toxicity.Spoken("")) == 0
    labels = [int(i % 5 == 0) for i in range(60)]
    held, fit = [], toxicity.fit

    def counting(toxic, clean, how):
        held.append(tracemalloc.get_traced_memory()[0] - before)
        return fit(toxic[:1], clean[:1], toxicity.Training(witnesses=20, clean_spans=40, pool=60, worst=10, landmarks=10, varied=5, rounds=1))

    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    with mock.patch.object(toxicity, "fit", counting):
        toxicity.fitted(texts, labels)
    tracemalloc.stop()
    assert len(held) == 3 and max(held) < 2 << 20
