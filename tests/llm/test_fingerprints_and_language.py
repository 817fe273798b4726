import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heatgrid.llm import langid, order_minhash

LONG = lambda x: x - (1 << 64) if x >> 63 else x


def brute_signature(text):
    """Order MinHash in plain Python, on Spark's chained XXH64."""
    def chain(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), h)
        return LONG(h)

    words = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text or "")
    n = max(len(words) - 4, min(len(words), 1))
    seen, kmers = {}, []
    for i in range(n):
        h = chain([w.encode() for w in words[i : i + 5]]) >> 28
        k = seen.get(h, 0)
        seen[h] = k + 1
        if k:
            h = LONG(xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", h), 42))) >> 28
        kmers.append((h, i))
    sketches = {}
    for h, i in sorted(kmers):
        own = sketches.setdefault((h >> 31) & 31, [])
        if len(own) < 2:
            own.append((i, h & (2**31 - 1)))
    return {(s, chain([h for _, h in sorted(own)]) % 2**64 >> 5) for s, own in sketches.items()}


TEXTS = [None, "", " \n\t ", "one", "one two three", "a b c d e f g h", "a b c d e a b c d e a b c d e", "x" * 5000, "le été là " * 300, "w1 w2 w3 w4 w5 w6 " * 2000, "日本語" * 40]


def signatures(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = order_minhash.fingerprint_documents(docs).orderBy("doc_id").collect()
    return [{(x % 2**64 >> 59, x % 2**59) for x in r.signature} for r in rows]


def test_signature_against_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()] + TEXTS
    for t, own in zip(texts, signatures(spark, texts), strict=True):
        assert own == brute_signature(t)


def test_repeats_are_told_apart_and_order_counts(spark):
    once, twice, thrice = signatures(spark, ["a b c d e f", "a b c d e f " * 20, "a b c d e f " * 40])
    assert len(once) <= 2 and len(twice) > len(once) and len(thrice) >= len(twice)
    words = [f"w{i}" for i in range(300)]
    base, near, turned = signatures(spark, [" ".join(words), " ".join(words[:150] + ["new"] + words[150:]), " ".join(words[150:] + words[:150])])
    share = lambda a, b: len(a & b) / len({s for s, _ in a | b})
    assert share(base, near) > 0.8
    assert share(base, turned) < share(base, near)


def test_query_on_small_tables(spark, sf_dir, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    for name, own in (("many", rows), ("one", rows[6:7]), ("none", [])):
        spark.createDataFrame(own, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = {r.doc_id: r for r in order_minhash.op5_order_minhash(spark, f"{tmp_path}/{name}").collect()}
        assert set(got) == {d for d, _ in own}
        for i, (d, t) in enumerate(own):
            text, after = t or "", own[(i + 1) % len(own)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            r = got[d]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if edited == text:
                assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint


@pytest.mark.parametrize("rows_a_bucket", [1, 7, 100])
def test_next_rows(spark, rows_a_bucket):
    ids = sorted({i * i % 997 for i in range(300)})
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next_text for r in order_minhash.with_next(docs, ["text"], rows_a_bucket=rows_a_bucket).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**7, None, None, None, 0), (10**7 + 1, "12 -- 34", "en", None, 0), (10**7 + 2, "", None, None, 0), (None, "the and of the", None, None, 0)], docs.schema)
    docs = docs.union(extra).withColumn("Score", F.lit("clash"))
    model = langid.train_on_documents(docs)
    rows = langid.identify(docs, model).withColumn("held_out", langid.held_out()).collect()
    assert {r.lang_pred for r in rows} <= {*model.langs, "und"} and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id and r.doc_id >= 10**7] == ["und"] * 3
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count() - 3


def test_language_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    for own in (docs, docs.limit(0)):
        assert [r.lang_pred for r in langid.identify(own, langid.train_on_documents(own)).collect()] in ([], ["und"])


@pytest.mark.parametrize("doc_id", [None, 5, 1])
def test_language_with_null_or_equal_ids(spark, sf_dir, doc_id):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL")
    langs = {r.lang for r in docs.select("lang").distinct().collect()}
    labelled = docs.withColumn("doc_id", F.lit(doc_id).cast("long")).select("doc_id", "text", "lang")
    model = langid.train(labelled)
    assert set(model.langs) == langs
    found = langid.identify(labelled, model).where("lang_pred <> 'und'")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_the_sample_is_bounded_and_of_different_rows(spark):
    rows = [(i % 7 or None, f"words of number {i % 700} and more", "en" if i % 3 else "de") for i in range(7000)] + [(1, "same text", "fr")] * 500
    sample = langid._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    got = {lang: sum(x[0] == lang for x in sample) for lang in ("en", "de", "fr")}
    assert got["fr"] == 1 and 30 <= got["en"] <= 50 and 30 <= got["de"] <= 50


def plain_ftrl(rows, dim, classes, epochs, alpha, beta, l1, l2):
    """Coordinate by coordinate, from the published formulas."""
    z = [[0.0] * classes for _ in range(dim)]
    n = [[0.0] * classes for _ in range(dim)]

    def w(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            y, x = rows[r]
            weights = {i: [w(i, c) for c in range(classes)] for i in x}
            score = [sum(v * weights[i][c] for i, v in x.items()) for c in range(classes)]
            e = [math.exp(s - max(score)) for s in score]
            for i, v in x.items():
                for c in range(classes):
                    g = (e[c] / sum(e) - (c == y)) * v
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * weights[i][c]
                    n[i][c] += g * g
    return np.array([[w(i, c) for c in range(classes)] for i in range(dim)])


def test_ftrl_against_plain_formulas():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        at = np.sort(rng.choice(40, 6, replace=False))
        v = rng.random(6)
        rows.append((int(at.sum() % 3), at, v / np.linalg.norm(v)))
    weights, bias = langid.fit_ftrl(rows, 3, epochs=2, alpha=0.4, beta=1.0, l1=0.05, l2=0.03)
    own = [(y, {**dict(zip(at.tolist(), v.tolist(), strict=True)), 40: 1.0}) for y, at, v in rows]
    want = plain_ftrl(own, 41, 3, 2, 0.4, 1.0, 0.05, 0.03)
    assert np.allclose(weights[:40], want[:40], atol=1e-12) and np.allclose(bias, want[40], atol=1e-12)
    assert (weights[:40] == 0).any() and (weights[40:] == 0).all()  # the L1 penalty leaves weights at zero


def test_temperature_against_a_scan():
    rng = np.random.default_rng(6)
    logits = rng.normal(size=(300, 4)) * 5
    classes = np.where(rng.random(300) < 0.7, logits.argmax(1), rng.integers(0, 4, 300))
    smooth = 1 / 302

    def loss(t):
        p = np.exp(logits / t - (logits / t).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return -((1 - smooth) * np.log(np.maximum(p[np.arange(300), classes], 1e-300)) + smooth * np.log(np.maximum(p, 1e-300)).mean(1)).mean()

    scan = np.exp(np.linspace(-4, 3, 4000))
    best = scan[np.argmin([loss(t) for t in scan])]
    assert abs(math.log(langid.fit_temperature(logits, classes) / best)) < 0.01


def test_features_of_short_and_long_texts_agree():
    text = "Ein kurzer Satz mit Wörtern. "
    short, long = (dict(zip(*map(list, langid.features(t)), strict=True)) for t in (text, text * 2000))
    same = set(short) & set(long)
    assert len(same) >= len(short) - 2 and all(abs(long[b] - short[b] - np.log(2000)) < 0.25 for b in same)  # the ends of the text count apart


def made_up_languages(n, rows, seed=4):
    """(doc_id, text, lang): each language has its own words of three syllables."""
    r = random.Random(seed)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiouyäöüø"]
    out = []
    for k in range(n):
        words = ["".join(r.sample(syllables, 3)) for _ in range(15)]
        out += [(k * rows + i, " ".join(r.choices(words, k=40)), f"l{k:04d}") for i in range(rows)]
    return out


def test_all_of_three_hundred_languages_are_learned(spark):
    own = made_up_languages(300, 12)
    model = langid.train(spark.createDataFrame([x for x in own if x[0] % 4], "doc_id long, text string, lang string"))
    assert len(model.langs) == 300 and model.dim * 300 <= langid.WEIGHTS and model.dim < langid.DIM
    held = [x for x in own if x[0] % 4 == 0]
    right = [x[2] for x in held if model.predict(x[1])[0] == x[2]]
    assert len(right) > 0.97 * len(held) and len(set(right)) > 290


def test_labels_that_are_no_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "WEIGHTS", langid.LEAST_DIM * 5)
    with pytest.raises(ValueError, match="labels"):
        langid.train(spark.createDataFrame(made_up_languages(6, 1), "doc_id long, text string, lang string"))


def test_the_least_score_lies_between_chance_and_the_least_sure(spark):
    log_odds = lambda p: np.log(p / (1 - p))
    for k in (2, 4, 300):
        for low in (0.55, 0.9, 0.999):
            right = np.r_[np.full(2000, 0.9995), np.full(20, low)]
            got = langid.least_score(right, k)
            assert 1 / k < got < low and abs(2 * log_odds(got) - log_odds(1 / k) - log_odds(low)) < 1e-9
    assert langid.least_score(np.array([1.0]), 4) < 1 and langid.least_score(np.array([]), 4) == 0.25
    assert langid.least_score(np.array([1.0]), 1) == 0.0  # a single language is never in doubt
    few = langid.train(spark.createDataFrame([(1, "ein Satz", "de"), (2, "a phrase", "en")], "doc_id long, text string, lang string"))
    assert few.min_score == 0.5


def test_what_the_pipeline_rejects(spark):
    """A language that none has learned and letters at random go; short clean texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(1)
    foreign = ["lorem ipsum", "aaaaaaaa", "Ovo je kratka recenica na hrvatskom jeziku koja nije naucena", "これは日本語で書かれた文章です。学習した言語ではありません。", "Это предложение написано по-русски, и модель не знает этого языка."]
    noise = ["".join(r.choice("qxzjkwvyq") + r.choice("ĸđŋħŧ") for _ in range(60)) for _ in range(3)]
    clean = [x.text for x in docs.where("lang = 'en' AND length(text) BETWEEN 30 AND 200").orderBy("doc_id").limit(40).collect()]
    extra = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(foreign + noise)], docs.schema)
    found = langid.keep_identified(docs.union(extra)).select("doc_id", "text").collect()
    assert not [x for x in found if x.doc_id >= 10**9]
    assert len(clean) > 10 and set(clean) <= {x.text for x in found}
