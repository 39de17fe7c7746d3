"""Operators with exact answers, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memloom.llm import chat_format, decontamination, license_scan, near_dedup, packing, quality_rules, range_coder, token_files, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(70_000))


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, columns that clash with outputs."""
    rows = [(1, None), (2, ""), (3, LONG), (4, "a b c"), (4, "a b c"), (None, "x y z"), (5, " \n\t "), (6, "Ünï Çödé 你好")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    return df.withColumns({"score": F.lit("mine"), "N_WORDS": F.lit("mine"), "kept": F.lit(1), "fingerprint": F.lit(0), "start": F.lit(0), "w": F.lit(0), "items": F.lit(0)})


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(points):
    """Smallest id reachable, by brute force over all pairs."""
    label = dict(enumerate(points))
    ids = list(range(len(points)))
    parent = ids[:]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in range(i):
            if bin(label[i] ^ label[j]).count("1") <= 2 and (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in ids]


def test_fingerprints_and_spark_hash(spark):
    texts = ["The cat  sat\non the MAT", "one two", "", "ÀB c d", "a a a a a"]
    assert [near_dedup.fingerprint(t) for t in texts] == [fingerprint(t) for t in texts]
    assert near_dedup.fingerprint(None) == 0
    assert spark.sql("select xxhash64('the cat sat')").head()[0] % 2**64 == xxhash.xxh64_intdigest(b"the cat sat", 42)


def test_tree_loses_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    points = [base]
    for _ in range(3):
        points.append(points[-1] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    dense = np.uint64(77) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    p = np.unique(np.concatenate([*points, dense, dense ^ np.uint64(12)]))
    want = components(p.tolist())
    for depth in (0, 2, 5):
        which, shard = near_dedup.shards(p, near_dedup.top(p, depth), depth)
        parent = list(range(len(p)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for s in np.unique(shard):
            at = which[shard == s]
            edges = near_dedup.forest(p[at])
            assert len(edges) < max(1, len(at))
            for a, b in edges:
                assert bin(int(p[at[a]] ^ p[at[b]])).count("1") <= 2
                if (x := root(at[a])) != (y := root(at[b])):
                    parent[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(p))] == want


def test_clusters_that_vantage_points_do_not_split(monkeypatch):
    """Points within four bits of one: the same forest's components by counting out all pairs and by looking up what is near."""
    rng = np.random.default_rng(6)
    points = {77}
    for _ in range(2000):
        x = 77
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            x ^= 1 << int(b)
        points.add(x)
    p = np.array(sorted(points | {int(x) for x in rng.integers(0, 1 << 62, 200)}), np.uint64)

    def of(edges):
        parent = list(range(len(p)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            assert bin(int(p[a] ^ p[b])).count("1") <= 2
            x, y = root(a), root(b)
            assert x != y  # a forest: no edge too many
            parent[max(x, y)] = min(x, y)
        return [root(i) for i in range(len(p))]

    want = of(near_dedup.forest(p))
    assert want == components(p.tolist())
    monkeypatch.setattr(near_dedup, "LEAF", 40)
    monkeypatch.setattr(near_dedup, "CLUSTER", 50)
    assert of(near_dedup.forest(p)) == want


def test_near_dedup(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARD", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        t = [rng.choice(words) for _ in range(200)]
        for k in range(rng.randint(1, 5)):
            texts.append(" ".join(t))
            t[rng.randrange(200)] = rng.choice(words)
    texts += ["", None, " \n"]
    got = near_dedup.classes(documents(spark, texts)).orderBy("doc_id").collect()
    fps = [fingerprint(t) for t in texts]
    assert [int(r["fingerprint"], 16) for r in got] == fps and all(len(r["fingerprint"]) == 16 for r in got)
    assert [r["component_id"] for r in got] == components(fps)
    kept = near_dedup.keep_one(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(components(fps))) and kept.columns == documents(spark, texts).columns


def test_near_dedup_odd_rows(spark):
    odd = odd_documents(spark)
    got = near_dedup.classes(odd)
    assert got.count() == 8
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got.collect()}
    assert by[2, "0" * 16] == by[1, "0" * 16] == by[5, "0" * 16] == 1
    assert next(r["component_id"] for r in got.collect() if r["doc_id"] is None) is None
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "None"]
    assert near_dedup.classes(odd.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def judged(docs, items):
    def words(t):
        return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    grams = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams[tuple(w[i : i + 13])].add(str(k))
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if names := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_TEXT", -1)
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choice("The of AND É été x1 to in".split()) for _ in range(n))
    items = [(10, pick(40)), (9, pick(13)), (8, "short Item"), (7, ""), (6, None), (5, "short item"), (10, pick(20))]
    docs = [(i, pick(30) + ", " + rng.choice(items[:3])[1].lower() + ". " + pick(rng.randint(0, 300))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "SHORT ITEM"), (53, "!!"), (54, items[0][1] + " " + items[0][1])]
    got = decontamination.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(judged(docs, items))


def test_decontamination_odd_rows(spark):
    odd = odd_documents(spark)
    bench = spark.createDataFrame([(1, "a b c"), (None, "x y z")], "item_id long, text string").withColumn("n_words", F.lit(1))
    got = decontamination.judge(odd, bench).collect()
    assert len(got) == 8 and sum(r["contaminated"] for r in got) == 3
    assert next(r["n_items"] for r in got if r["doc_id"] is None) == 0
    assert decontamination.judge(odd.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.judge(odd, bench.limit(0)).collect())


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("spared", [1, (1 << 60) - 1, (1 << 62) - 1])
def test_rule_counts(spark, monkeypatch, spared):
    """The same counts where all but a few bits of the hashes are given up, so that most of them collide."""
    monkeypatch.setattr(quality_rules, "HASH_BITS_SPARED", spared)
    rng = random.Random(5)
    texts = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(["a ", "b ", "é# ", "c\n", "\t", "d\n", " \r\n", " "]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += ["one two \u0085", "one two \u2028", "\u2029 one\u2028\n", "a b \r\u0085"]
    got = {r["text"]: r for r in quality_rules.statistics(documents(spark, [*texts, None, LONG])).collect()}
    for t in [*texts, None, LONG]:
        assert tuple(got[t][c] for c in quality_rules.BASE) == counts(t), t
        n, _, _, _, again = counts(t)
        assert got[t]["base_failed"] == (n < 50 or 100 * again > 50 * n)


def robust(x, share, steps, floor):
    """The same estimate by numpy, with the same histogram of distances."""
    def est(a):
        m = a.mean(0)
        return m, (a.T @ a) / len(a) - np.outer(m, m) + np.diag(np.square(floor))

    def far(a, m, c):
        z = np.linalg.solve(np.linalg.cholesky(c), (a - m).T)
        return (z * z).sum(0)

    m, c = est(x)
    for _ in range(steps):
        b = np.floor(np.log2(far(x, m, c) + 1e-3) * 32)
        m, c = est(x[b <= np.sort(b)[int(np.ceil(share * len(b))) - 1]])
    return far(x, m, c)


def test_rule_verdicts(spark):
    rng = random.Random(6)
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(60, 300))) for _ in range(150)]
    junk = [" ".join("abc&&&&%%%%$$$$" + str(i) + "x" * 30 for i in range(100 + k)) for k in range(5)]
    df = documents(spark, plain + junk).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    rules = quality_rules.Rules()
    stats = quality_rules.statistics(df).drop("text")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    xs = {r["doc_id"]: [r[f"x{i}"] for i in range(5)] for r in stats.select("doc_id", *[c.alias(f"x{i}") for i, c in enumerate(quality_rules.vector())]).collect()}
    for parity in (0, 1):
        ids = [i for i in xs if i % 2 == parity and not got[i]["base_failed"]]
        d = robust(np.array([xs[i] for i in ids]), rules.share, rules.steps, rules.floor)
        assert [got[i]["kept"] for i in ids] == (d <= rules.cutoff).tolist()
    assert all(got[i]["kept"] for i in range(150) if not got[i]["base_failed"]) and not any(got[i]["kept"] for i in range(150, 155))


def test_rules_odd_rows(spark):
    odd = odd_documents(spark)
    got = quality_rules.judge(odd).collect()
    assert len(got) == 8 and all(isinstance(r["kept"], bool) for r in got)
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_word_encoder_is_the_tokenizer():
    e = tokens.WordEncoder(tokens.default_path(), kept=50)
    texts = ["", "a\x01b c", "<|endoftext|> x <|ENDOFTEXT|>", "It's  we'll\tTHE x ÉÈ É Σ ΑΣ. İ", "0x12 3.4...5 !!! a,b", "\x01", "  ", "é ́x", LONG[:4000], "line\nbreak   sep arated"]
    for _ in range(2):
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == [*e._tokenizer.encode(t, add_special_tokens=False).ids, 1]
    assert len(e._ids) < 600


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(1)
    for sizes in ([], [4096], [4095, 1], [2048] * 3, [1] * 5000, [3000] * 10 + [500] * 7 + [596] * 3, rng.integers(1, 4097, 3000).tolist(), np.minimum(4096, rng.lognormal(6, 1.3, 20000).astype(int) + 1).tolist()):
        want = collections.Counter(sizes)
        plan = packing.plan(dict(want))
        used = collections.Counter()
        for kinds, n in plan:
            assert n > 0 and sum(a * b for a, b in kinds) <= 4096
            for a, b in kinds:
                used[a] += b * n
        assert used == want
    assert sum(n for _, n in plan) <= -(-sum(sizes) // 4096) * 1.01 + 1


def test_packing(spark):
    texts = ["one two three", None, "", LONG, *[f"text number {i} of some length " * (i % 40) for i in range(200)]]
    out = packing.pack(documents(spark, texts), with_ids=True).cache()
    rows = out.orderBy("doc_id", "piece").collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(texts):
        assert b"".join(r["ids"] for r in by_doc[i]) == ids_of(t).tobytes()
        assert [r["start"] for r in by_doc[i]] == [4096 * k for k in range(len(by_doc[i]))] and all(r["length"] == 4096 for r in by_doc[i][:-1])
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        ends = 0
        for at, n in sorted(spans):
            assert at == ends
            ends += n
        assert ends <= 4096
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 4096) + 2
    made = packing.sequences(out).collect()
    assert sum(r["length"] for r in made) == total and all(len(r["ids"]) == 4 * r["length"] for r in made)
    assert packing.pack(odd_documents(spark)).select("doc_id").distinct().count() == 7
    assert packing.pack(odd_documents(spark).limit(0)).count() == 0


def test_coder_round_trips():
    rng = np.random.default_rng(3)
    for ids in ([], [7], [65535] * 600, rng.integers(0, 65536, 3000), rng.integers(0, 1 << 32, 900), rng.permutation(1 << 17), rng.zipf(1.4, 2000) % 49408):
        ids = np.array(ids, "<u4")
        coded = range_coder.encode(ids)
        assert (range_coder.decode(coded) == ids).all() and len(range_coder.decode(coded)) == len(ids)
    assert len(range_coder.encode(np.full(200_000, 7, "<u4"))) < 6000
    for spoil in (coded[:-2], *(coded[:k] + bytes([coded[k] ^ 129]) + coded[k + 1 :] for k in (5, 13, 30, 60, 200, len(coded) // 2)), b"nope" + coded[4:]):
        with pytest.raises(ValueError):
            range_coder.decode(spoil)


def test_coder_predicts(monkeypatch):
    """Ids of which each follows from those before it: fewer bytes than order 0 can reach, and than zlib's; segments on their own."""
    rng = np.random.default_rng(4)
    follows = rng.integers(0, 500, (500, 4))
    ids = [0]
    for k in rng.choice(4, 120_000, p=[0.55, 0.25, 0.15, 0.05]):
        ids.append(int(follows[ids[-1], k]))
    ids = np.array(ids, "<u4")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    coded = range_coder.encode(ids)
    assert 8 * len(coded) < -(share * np.log2(share)).sum() * len(ids) * 0.85 and len(coded) < len(zlib.compress(ids.astype("<u2").tobytes()))
    monkeypatch.setattr(range_coder, "SEGMENT", 50_000)
    assert (range_coder.decode(range_coder.encode(ids)) == ids).all()


def test_leaders_by_counting():
    """The commonest symbol after each context and the second, smaller symbols first, and the class of the first's share."""
    rng = np.random.default_rng(6)
    for contexts, n in ((1, 0), (5, 1), (40, 3000), (3000, 2000)):
        context, symbol = rng.integers(0, contexts, n).astype(np.uint32), (rng.zipf(1.5, n) % 12).astype(np.uint32)
        best, second, sure = range_coder._leaders(context, symbol, contexts)
        for c in range(contexts):
            told = sorted(collections.Counter(symbol[context == c].tolist()).items(), key=lambda x: (-x[1], x[0]))
            first = told[0][0] if told else 0
            assert best[c] == first and second[c] == (told[1][0] if len(told) > 1 else int(first != 1))
            assert sure[c] == (min(int(8 * (told[0][1] - 0.5) / (sum(k for _, k in told) + 1)), 7) if told else 0)
    table = rng.integers(0, 9, (130, 70)).astype(np.uint8)
    assert np.array_equal(range_coder._turned(table), table.T)


def test_mixed_steps_by_brute_force():
    """Words of one block by whole-number arithmetic without lanes or registers: the value lies in the interval of its ids."""
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.5, 300) % 40).astype("<u4")
    known, symbols = range_coder.Predictions.of(ids, 512)
    kinds, contexts = known.kinds(symbols.reshape(-1, 1))
    weights = {(i // range_coder.CLASSES, i % range_coder.CLASSES): list(map(int, w)) for i, w in enumerate(known.weights)}
    before, before_that, low, size, scale = 0, 0, 0, 1 << 48, 0
    for x in map(int, symbols):
        slot = ((before * 0x9E3779B1 + before_that * 0x85EBCA6B) % 2**32) >> (32 - known.slot_bits)
        two, (one, second) = int(known.two[slot]), map(int, known.one[before])
        two = one if known.sure2[slot] < known.sure1[before] else two
        one = second if one == two else one
        w = weights[int(known.sure2[slot]), int(known.sure1[before])]
        a, b = ((v >> 4) - (v >> 9) + 1 for v in w)
        unit = size >> 12
        if x == two:
            hit, start, size = (65535, 0), 0, unit * a
        elif x == one:
            hit, start, size = (0, 65535), unit * a, unit * b
        else:
            each = (unit * (4096 - a - b)) >> known.bits
            hit, start, size = (0, 0), unit * (a + b) + each * int(known.upto[x]), each * int(known.freq[x])
        low += start
        w[:] = [v + ((h - v) >> range_coder.RATE) for v, h in zip(w, hit, strict=True)]
        while size < 1 << 32:
            low, size, scale = low << 16, size << 16, scale + 16
        before_that, before = before, x
    out, used = range_coder._encode_lanes(symbols.reshape(-1, 1), kinds, contexts, known)
    value = 0
    for w in out:
        value = value << 16 | int(w)
    assert len(out) == used[0] and low <= value << max(0, 48 + scale - 16 * len(out)) < low + size


def test_words_are_looked_up_in_arrow():
    """Texts as a list or an Arrow array, in one slice or in many, with words kept or not, get the ids that the library gives each."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [None, "", " ", "\n", " a", "A b\n\nC  ", "<|endoftext|> X", "<|EndOfText|>", "ÄÖ Größe!*", "\x01 q", "a\x01b", "İ K", "  b\tc\r\nd", "日本語 テキスト", "A" * 5000]
    texts += [" ".join("".join(map(chr, rng.integers(97, 123, 4))) + str(rng.choice(["", ".", "!*", ","])) for _ in range(200)) for _ in range(20)]
    for kept in (1, 40, 100_000):
        e = tokens.WordEncoder(tokens.default_path(), kept)
        for some in (texts, pa.array(texts, pa.string()), pa.array(["x", *texts])[1:], texts[::-1]):
            got = list(e.encode(some))
            want = texts[::-1] if some == texts[::-1] else texts
            assert all(np.array_equal(np.frombuffer(g, "<u4"), ids_of(t)) for g, t in zip(got, want, strict=True))
        assert len(e._met) <= max(kept, 1) and len(e._met) == len(e._size) and e._size.sum() == len(e._known)
        assert not list(e.encode([])) and not list(e.encode(pa.array([], pa.string())))
    assert list(e.encode(["\ud800 z"])) == list(e.encode(["? z"]))


def test_words_without_their_signs_are_asked_once():
    """A slice's words reach the library once each, whatever signs end them and however often; ids are the library's, in any form of letters."""
    import pyarrow as pa

    e = tokens.WordEncoder(tokens.default_path())
    asked, learn = [], e._learn
    e._learn = lambda words, kinds: asked.extend(words) or learn(words, kinds)

    def right(texts, want):
        return all(np.frombuffer(g, "<u4").tolist() == [*e._tokenizer.encode(t, add_special_tokens=False).ids, 1] for g, t in zip(e.encode(texts), want, strict=True))

    texts = ["zzyzx größenü zzyzx. größenü!* (zzyzx", "zzyzx!* größenü. ,,, zzyzx,,, größenü(", "zzyzx(! größenü?? zzyzx"] * 50
    assert right(texts, texts)
    assert sorted(asked) == sorted({"zzyzx", "größenü", ".", "!*", "(zzyzx", ",,,", "(", "(!", "??"}) and set(asked) < set(e._met)
    odd = ["İ.", "\u0958.", "×.", "a÷!", "é.", "e\u0301.", "한.", "<|x|>.", "<|endoftext|>.", "\x01.", "a\x01.", "'s.", "don't.", "Ⅷ.", "²!", "..", "a..b..", "\u00c3.", "😀.", "\t.", "a\t.", "a\r\n."]
    assert right(odd, odd) and right([" ".join(odd)], [" ".join(odd)])
    assert right(pa.array(["ÄÖÜ ab", *odd])[1:], odd) and right(pa.array(["ÄÖÜ ab", *odd, "z"], pa.large_string())[1:-1], odd)


def test_token_files(spark, tmp_path):
    texts = ["one two", None, "", LONG[:3000], *[f"text {i} " * (i % 9) for i in range(60)]]
    docs = documents(spark, texts).orderBy(F.rand(1))
    token_files.write(docs, str(tmp_path / "f"), chunk=300, part=1500)
    assert spark.read.parquet(str(tmp_path / "f")).select("part").distinct().count() > 2
    got = token_files.read(spark, str(tmp_path / "f"), with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, texts, strict=True):
        want = ids_of(t)
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += len(want)
    token_files.write(odd_documents(spark), str(tmp_path / "odd"))
    rows = token_files.read(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert len(rows) == 8 and rows[0]["doc_id"] is None and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    same = documents(spark, ["one text"] * 400).withColumn("doc_id", F.lit("x"))
    token_files.write(same, str(tmp_path / "same"), part=500)
    rows = token_files.read(spark, str(tmp_path / "same")).orderBy("start").collect()
    assert spark.read.parquet(str(tmp_path / "same")).select("part").distinct().count() > 3 and [r["start"] for r in rows] == [3 * i for i in range(400)]
    token_files.write(odd_documents(spark).limit(0), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_token_file_parts_from_every_row(spark):
    """Parts are even whatever share of the rows has the text, and the coder's predictions count every id."""
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10_000 == 77, F.repeat(F.lit("a"), 60_000)).otherwise("b").alias("text"))
    first = token_files.bounds(docs, part=60_000)
    size = np.array([60_001 if i % 10_000 == 77 else 2 for i in range(n)])
    upto = np.cumsum(size)
    parts = -(-int(size.sum() - n) // 60_000)
    want = sorted({int(np.searchsorted(upto - 1, j * int(upto[-1]) / parts)) for j in range(1, parts)})
    assert [k[1] for k in first] == want
    at = np.arange(1 << 21)
    ids = np.where(at % 2, np.where(at // 1024 % 4, 3, 2), 1).astype(np.uint32)  # in three blocks of four, 3 follows 1
    known, _ = range_coder.Predictions.of(ids, 1024)
    assert [known.ids[x] for x in known.one[0]] == [3, 2] and (range_coder.decode(range_coder.encode(ids)) == ids).all()


def test_chat_format(spark):
    rng = random.Random(7)
    turns, said = [], {}
    for c in range(60):
        n = rng.randint(1, 5)
        said[c] = tuple((("user", "assistant")[i % 2], rng.choice("ab") if i else "hi") for i in range(n))
        turns += [(c, i, r, t) for i, (r, t) in enumerate(said[c])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    first = {}
    for c in sorted(said):
        first.setdefault(said[c], c)
    want = {c for s, c in first.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in first)}
    got = chat_format.render(df.unionByName(df.limit(5))).collect()
    assert {r["conv_id"] for r in got} == want
    for r in got:
        assert r["rendered"] == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in said[r["conv_id"]]) and r["copies"] == sum(s == said[r["conv_id"]] for s in said.values())


def test_chat_format_odd_rows(spark):
    rows = [(1, 0, None, "x"), (1, 1, "user", None), (None, 0, "user", "q"), (2, None, "user", "long " * 50_000), (3, 0, "user", "a"), (3, 0, "assistant", "b"), (4, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "place": F.lit("p"), "rendered": F.lit(0)})
    got = {r["conv_id"]: r["rendered"] for r in chat_format.render(df).collect()}
    assert got[1] == "<|im_start|>user\nx<|im_end|>\n<|im_start|>user\n<|im_end|>\n" and got[None].count("q") == 1 and got[3].index("b") < got[3].index("a<") and set(got) == {1, 2, 3, 4, None}
    assert chat_format.render(df.limit(0)).count() == 0


def test_license_scan(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/b/x.txt", "nothing"), ("r/a/y.txt", "words\nLicensed under the Apache License, Version 2.0."), ("r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("r/a/b/z.txt", None), ("q/x.txt", ""), ("top.txt", "license to drive"), (None, "All rights reserved."), ("r/c/d/e/f.txt", "x"), ("r/a/y.txt", "words\nLicensed under the Apache License, Version 2.0."), ("big.txt", LONG + "\nAll rights reserved."),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({"license": F.lit(1), "score": F.lit("x")})
    got = collections.Counter((r["path"], r["license"], r["origin"], r["from_path"]) for r in license_scan.scan(files).collect())
    assert got == collections.Counter({
        ("r/LICENSE", "MIT", "own", None): 1, ("r/a/b/x.txt", "GPL-3.0", "inherited", "r/a"): 1, ("r/a/y.txt", "Apache-2.0", "own", None): 2, ("r/a/COPYING", "GPL-3.0", "own", None): 1, ("r/a/b/z.txt", "GPL-3.0", "inherited", "r/a"): 1,
        ("q/x.txt", None, "none", None): 1, ("top.txt", None, "none", None): 1, (None, None, "none", None): 1, ("r/c/d/e/f.txt", "MIT", "inherited", "r"): 1, ("big.txt", "Proprietary", "own", None): 1,
    })
    assert license_scan.scan(files.limit(0)).count() == 0
