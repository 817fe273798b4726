"""Token counts against the libraries, and what the cache keeps and asks for."""

import random

import pytest
from heatgrid.llm import token_counts as tc
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

BYTES = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(BYTES)
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


def counts(df):
    assert df.columns[-2:] == ["n_bytes", "n_tokens"]
    return sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect())


def cached(spark, cache):
    return spark.read.parquet(cache)


def test_random_texts_equal_the_library(library):
    r, own = random.Random(1), tc.counter(BYTES)
    assert isinstance(own, tc.ByteLevelCounter)
    letters = [*"ab1 .,'\n\t\r  ", "é", " ", " ", "中", "😀", "'s", "'ll", "\x1c", "\x85", "<|endoftext|>", "́", "ǅ", "Ⅷ", "٣", "꟎", "\U0001f6d8"]
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        assert own(text) == library(text), repr(text)


def test_all_characters_split_as_the_library_does():
    split, own, letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), tc.regex.compile(tc.BYTE_LEVEL).findall, tc.byte_letters()
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or tc.OTHER.search(c):
            continue
        text = f"a{c}b 1{c}1 !{c}!{c} x"
        assert [x for x, _ in split.pre_tokenize_str(text)] == ["".join(letters[b] for b in x.encode()) for x in own(text)], hex(code)


def test_whole_table_equals_the_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = tc.op13_token_counts(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((r.doc_id, len((r.text or "").encode()), library(r.text), library(r.text) > 512) for r in rows)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_odd_rows(spark, tmp_path, library):
    texts = [None, "", " ", "a<|endoftext|>b", "same", "same", "same", "x" * 200_000, "é中😀 \n\n  a", "Same"]
    rows = [(i // 2 if i % 3 else None, t, "own", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Bytes string, digest int")
    got = tc.count_tokens(docs, BYTES, f"file://{tmp_path}/cache")
    assert got.columns == ["doc_id", "digest", "n_bytes", "n_tokens"]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=key) == sorted(((d, len((t or "").encode()), library(t)) for d, t, *_ in rows), key=key)
    assert cached(spark, f"file://{tmp_path}/cache").count() == len(set(map(lambda t: t or "", texts)))
    empty = tc.count_tokens(docs.limit(0), BYTES, f"file://{tmp_path}/none")
    assert empty.collect() == [] and not (tmp_path / "none").exists()


def test_only_misses_are_encoded_and_appended(spark, tmp_path, library, monkeypatch):
    cache, asked = f"file://{tmp_path}/cache", []
    encode = tc.encode_misses
    monkeypatch.setattr(tc, "encode_misses", lambda texts, path: asked.append(texts.count()) or encode(texts, path))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 10).cast("string")).alias("text"))
    first = counts(tc.count_tokens(docs, BYTES, cache))
    assert asked == [10] and cached(spark, cache).count() == 10
    assert counts(tc.count_tokens(docs, BYTES, cache)) == first and asked == [10]
    more = docs.union(spark.createDataFrame([(100, "new"), (101, "new"), (102, "text 3")], "doc_id long, text string"))
    got = counts(tc.count_tokens(more, BYTES, cache))
    assert asked == [10, 1] and cached(spark, cache).count() == 11
    assert [x for x in got if x[0] < 100] == first and got[-3:] == [(100, 3, library("new")), (101, 3, library("new")), (102, 6, library("text 3"))]
    # beyond the bound of a broadcast the same
    monkeypatch.setattr(tc, "MAX_BROADCAST_ROWS", 0)
    counts(tc.count_tokens(more.union(spark.createDataFrame([(103, "newer")], "doc_id long, text string")), BYTES, cache))
    assert asked == [10, 1, 1] and cached(spark, cache).count() == 12
    # another tokenizer is another version: nothing is found
    counts(tc.count_tokens(docs, path("word_bpe_49k.json"), cache))
    assert asked == [10, 1, 1, 10] and cached(spark, cache).select("version").distinct().count() == 2


def test_counts_come_from_the_cache(spark, tmp_path):
    """A stored count is taken as it is; a digest appended twice counts once."""
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "known"), (2, "other")], "doc_id long, text string")
    stored = docs.where("doc_id = 1").select(tc.digest(F.col("text")).alias("digest"), F.lit(99).cast("long").alias("n_tokens"), F.lit(tc.tokenizer_version(BYTES)).alias("version"))
    for _ in range(2):
        stored.write.mode("append").partitionBy("version").parquet(cache)
    got = counts(tc.count_tokens(docs, BYTES, cache))
    assert len(got) == 2 and got[0] == (1, 5, 99) and got[1][2] < 99


def test_sentencepiece_models(spark, tmp_path):
    import sentencepiece

    model = path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["Ein Satz.", "", "</s> x", "语 \n a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x[2] for x in counts(tc.count_tokens(docs, model, f"file://{tmp_path}/cache"))] == [len(own.encode(t)) for t in texts]


def test_many_copies_are_dealt(spark, tmp_path, library):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = counts(tc.count_tokens(docs, BYTES, f"file://{tmp_path}/cache"))
    assert len(got) == 6000 and {x[2] for x in got if x[0] % 3} == {library("copy")}
