"""Token counts of documents through a cache of digests.

A row of the cache is (version, digest, n_tokens): the digest of a tokenizer's file, library and release, that of a
content as the tokenizer sees it, and how many tokens it has. Documents are joined to the cache by digest; of what is
missing each content is encoded once, however many documents have it, and appended. A changed tokenizer is another
version, so that nothing of the old one is found.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version as release

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import MAX_BROADCAST_ROWS, join_dealt, materialise, shared_dir, table, without

#: Words and pre-tokens whose counts a worker keeps, about 120 bytes each; what comes later is counted again.
CACHED = 600_000
CACHE_SCHEMA = "digest binary, n_tokens long, version string"

#: Fixed value: the published split pattern of byte-level BPE tokenizers with `use_regex`.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Outside of these blocks the library's and our letters, numbers and white space may be of different releases of Unicode.
OTHER = regex.compile("[^\u0000-\u052f\u1e00-\u206f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]")


# ---- counting in a worker


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteLevelCounter:
    """Counts of a tokenizer without a normaliser that splits by BYTE_LEVEL: the sum of its pre-tokens' counts, which recur.

    No pre-token goes over a single space between two characters that are none, so words with the space before them are
    kept as they are. Texts with an added token or a character of OTHER in them go to the library whole.
    """

    def __init__(self, inner):
        self.inner = inner
        self.added = tuple(t.content for t in inner.get_added_tokens_decoder().values())
        self.split = regex.compile(BYTE_LEVEL).findall
        self.letters = byte_letters()
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def part(self, part: str) -> int:
        n = self.parts.get(part)
        if n is None:
            n = len(self.inner.model.tokenize("".join([self.letters[b] for b in part.encode("utf-8")])))
            if len(part) <= 64 and len(self.parts) < CACHED:
                self.parts[part] = n
        return n

    def word(self, word: str) -> int | None:
        """Of a word after a space; None where a pre-token could go over its ends."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        n = sum(map(self.part, self.split(" " + word)))
        if len(word) <= 32 and len(self.words) < CACHED:
            self.words[word] = n
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if any(s in text for s in self.added) or not text.isascii() and OTHER.search(text):
            return len(self.inner.encode(text, add_special_tokens=False).ids)
        first, *words = text.split(" ")
        got = self.words.get
        counts = [got(w) for w in words]
        if None in counts:
            counts = [self.word(w) if n is None else n for w, n in zip(words, counts, strict=True)]
        if None in counts or not first or first[-1].isspace():
            return sum(map(self.part, self.split(text)))
        return sum(counts) + sum(map(self.part, self.split(first)))


def _is_byte_level(spec: dict) -> bool:
    model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = not any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word"))
    own = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    return plain and own and spec.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))


def counter(path: str) -> Callable[[str], int]:
    """How many tokens a text has: by tokenizers for .json, by sentencepiece for .model; no begin, end or added special tokens, nothing cut or padded."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, add_bos=False, add_eos=False))
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(path)
    inner.no_truncation()
    inner.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if _is_byte_level(spec):
        return ByteLevelCounter(inner)
    return lambda text: len(inner.encode(text, add_special_tokens=False).ids)


_COUNTERS: dict[str, Callable[[str], int]] = {}


def counter_of(path: str) -> Callable[[str], int]:
    """One counter a worker process and tokenizer."""
    if path not in _COUNTERS:
        _COUNTERS[path] = counter(path)
    return _COUNTERS[path]


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file and of the library's name and release."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {release(library)}\n".encode() + f.read()).hexdigest()


# ---- the cache


def content(text: Column) -> Column:
    """What is counted and digested: null is the empty text. Nothing else is made equal, as any other change of a text can change its tokens."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(content(text), 256))


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a folder of the shared store is there, asked through Spark's own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a digest that two jobs appended at once comes once."""
    if not _has_rows(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(path)
        for batch in batches:
            n = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    return texts.select("digest", "text").mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str, cache: str, column: str = "text") -> DataFrame:
    """Count the tokens of whole texts through the cache in the folder `cache`, which all executors share.

    Returns the columns of docs but for the text, and n_bytes (UTF-8), n_tokens. A null text is an empty one, of 0 tokens;
    repeated rows stay and are encoded once, as are equal texts; very long texts are counted whole. Own columns named
    n_bytes or n_tokens (in any case) are replaced. An empty table gives an empty one and appends nothing.

    Equal texts meet by digest: texts are shuffled once, after equal ones of a task have become one, and only those that
    the cache lacks. Counts return to documents by digest; a digest that many have is dealt over tasks.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    own = digest(F.col(f"`{column}`")).alias("digest")
    asked = materialise(docs.select(own).groupBy("digest").agg(F.count("*").alias("rows")), "token-digests")
    known = read_cache(spark, cache, version)
    total, n_known = asked.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], known.count()
    missing = asked.select("digest").join(known, "digest", "left_anti") if n_known else asked.select("digest")
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(own, content(F.col(f"`{column}`")).alias("text"))
        few = n_known and n_missing <= MAX_BROADCAST_ROWS
        if few:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n_known and not few:
            texts = texts.join(missing, "digest", "left_semi")  # both by digest already: texts don't move again
        encode_misses(texts, path).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    counts = asked.join(read_cache(spark, cache, version), "digest")
    keyed = without(docs, "n_bytes", "n_tokens").withColumns({"__digest": digest(F.col(f"`{column}`")), "n_bytes": F.octet_length(content(F.col(f"`{column}`"))).cast("long")}).drop(column)
    return join_dealt(keyed, counts.withColumnsRenamed({"digest": "__digest", "rows": "__rows"}), "__digest", "__rows", total).drop("__digest")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of all documents, with an empty cache of its own, so that every call does the whole work."""
    from public_tokenizers import path

    cache = f"{shared_dir(spark).rstrip('/')}/token-cache-{uuid.uuid4().hex}"
    docs = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path("byte_bpe_50k.json"), cache)
    return docs.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
