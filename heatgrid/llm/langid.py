"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one space; n-grams of one to three characters are hashed into DIM buckets.
Document frequencies cover all training rows. The weights are fitted by follow-the-regularised-leader (FTRL-proximal,
L1 and L2 penalties) on a bounded sample of labelled rows, then one temperature is fitted on a held-back part of it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import portions, table, without

DIM = 1 << 15
#: Bounds of the fitting sample: different rows a language, and rows in all; but LEAST_A_LANG a language up to LEAST_IN_ALL,
#: and two a language in any case.
ROWS_A_LANG, ROWS_IN_ALL, LEAST_A_LANG, LEAST_IN_ALL = 1000, 8000, 20, 40_000
#: Weights of a model. All languages are learned; of more than 256 the weights of several buckets are one, down to
#: LEAST_DIM buckets, and labels that would need fewer are no languages and refused.
WEIGHTS, LEAST_DIM = DIM * 256, 256
UNKNOWN = "und"
#: Share of the rightly identified held-back rows whose scores are set aside as the least sure ones.
LEAST_SURE = 0.001

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-cased letter, or a space; made once a process."""
    if not _FOLD:
        points = [chr(i) for i in range(sys.maxunicode + 1)]
        _FOLD.append(np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in points], np.uint32))
    return _FOLD[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket numbers, 1 + log counts) of a whole text; None without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.concatenate([[np.uint32(32)], _fold()[points], [np.uint32(32)]]).astype(np.uint32)
    folded = folded[np.r_[True, (folded[1:] != 32) | (folded[:-1] != 32)]]
    if len(folded) < 3:
        return None
    one = folded * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (folded[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (folded[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    h = np.concatenate([one, two, three])
    buckets = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(17)
    if len(buckets) < DIM // 4:
        at, n = np.unique(buckets, return_counts=True)  # no array of all buckets for a short text
        return at.astype(np.int64), 1 + np.log(n)
    counts = np.bincount(buckets.astype(np.int64), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    min_score: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.weights)

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, tf = found
        v = tf * self.idf[at]
        return at, v / max(np.linalg.norm(v), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); (und, 0) for null texts and texts without a letter."""
        found = features(text) if self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        at, v = self.vector(found)
        p = _softmax((v @ self.weights[at % self.dim] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents with a letter, documents that have each bucket) over all rows of `texts` (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(DIM, np.int64)
        for batch in portions(batches):
            for text in batch.column(0).to_pylist():
                if found := features(text):
                    total += 1
                    df[found[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, DIM], pa.int32()), pa.array(np.r_[df[at], total])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()  # DIM + 1 rows at most
    df = np.zeros(DIM + 1, np.int64)
    for bucket, n in rows:
        df[bucket] = n
    return int(df[DIM]), df[:DIM]


def _sample(labelled: DataFrame, rows_a_lang: int) -> list:
    """(lang, buckets, values) of at most rows_a_lang different labelled rows of each language, those with the smallest hash.

    The hash is of doc_id and text, so it matters not whether ids are null or repeat; equal rows are one. From the number
    of different hashes of a language follows which share of them is wanted, so only a little more than the sample is ranked.
    """
    h = F.xxhash64("doc_id", "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(h, 0.02).alias("different")).limit(WEIGHTS // LEAST_DIM + 1).collect()
    if not counts:
        return []
    if len(counts) > WEIGHTS // LEAST_DIM:
        raise ValueError(f"over {WEIGHTS // LEAST_DIM} different labels: they are no languages")
    rows_a_lang = min(rows_a_lang, max(2, ROWS_IN_ALL // len(counts), min(LEAST_A_LANG, LEAST_IN_ALL // len(counts))))
    # a fifth more than wanted, as hashes scatter
    bounds = {lang: min((1 << 63) - 1, int((2 * min(1.0, (1.2 * rows_a_lang + 20) / max(1, n)) - 1) * (1 << 63))) for lang, _, n in counts}
    limit = F.create_map(*[F.lit(x) for pair in sorted(bounds.items()) for x in pair])
    chosen = labelled.where(h <= F.try_element_at(limit, F.col("lang"))).select("lang", h.alias("h"), "text").dropDuplicates(["lang", "h"])
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= rows_a_lang).select("lang", "h", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            own = [(lang, h, found) for lang, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (found := features(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.int64()), pa.array([x[2][0].astype(np.int32).tobytes() for x in own], pa.binary()), pa.array([x[2][1].astype(np.float32).tobytes() for x in own], pa.binary())],
                ["lang", "h", "at", "tf"],
            )

    rows = chosen.mapInArrow(vectors, "lang string, h long, at binary, tf binary").collect()  # rows_a_lang rows a language at most
    return [(r.lang, np.frombuffer(r.at, np.int32), np.frombuffer(r.tf, np.float32)) for r in sorted(rows, key=lambda r: (r.h, r.lang))]


def _folded(at: np.ndarray, v: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values where only `dim` buckets have weights of their own."""
    if dim == DIM:
        return at, v
    own, place = np.unique(at % dim, return_inverse=True)
    return own, np.bincount(place, v, len(own))


def fit_ftrl(rows: list, n_classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dim x classes) and bias from (class, buckets, unit vector) rows, one FTRL-proximal step a row."""
    z, n = np.zeros((dim + 1, n_classes)), np.zeros((dim + 1, n_classes))

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            y, at, v = rows[i]
            at, v = np.r_[at, dim], np.r_[v, 1.0]
            w = weights(at)
            p = _softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(dim + 1))
    return w[:dim], w[dim]


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search over its logarithm.

    Each row also counts as one of any class with weight 1 / (rows + 2), so that a faultless sample does not ask for certainty.
    """
    smooth = 1 / (len(logits) + 2)

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(_softmax(logits / np.exp(log_t)), 1e-300))
        return -((1 - smooth) * p[np.arange(len(p)), classes] + smooth * p.mean(1)).mean()

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def least_score(right: np.ndarray, n_langs: int) -> float:
    """The score under which a document's language is in doubt: half-way in log odds from chance to the least sure of `right`.

    `right` has the scores of held-back rows whose language was found; without any, chance is where it begins. It moves with the number of
    languages and with how sure the model is. A single language is never in doubt.
    """
    chance = 1 / n_langs
    if n_langs == 1 or not len(right):
        return 0.0 if n_langs == 1 else chance
    low = min(max(float(np.quantile(right, LEAST_SURE)), chance), 1 - 1e-6)
    odds = np.sqrt(chance / (1 - chance) * low / (1 - low))
    return float(odds / (1 + odds))


def train(labelled: DataFrame, rows_a_lang: int = ROWS_A_LANG) -> Model:
    """Fit on `labelled` (doc_id, text, lang): rows without a language are left out. Without rows: a model that says und.

    Null and repeated ids are no matter; rows that repeat wholly are learned from once, but count as often as they come in
    the document frequencies. Rows whose text is null or has no letter teach nothing. All languages are learned, however
    many (WEIGHTS). Extra columns are not read.
    """
    labelled = labelled.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    total, df = document_frequencies(labelled)
    rows = _sample(labelled, rows_a_lang)
    langs = sorted({r[0] for r in rows})
    model = Model(langs, np.log((1 + total) / (1 + df)) + 1, np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    if not rows:
        return model
    dim = min(DIM, 1 << (WEIGHTS // len(langs)).bit_length() - 1)
    number = {lang: i for i, lang in enumerate(langs)}
    data = [(number[lang], *_folded(*model.vector((at, tf.astype(np.float64))), dim)) for lang, at, tf in rows]
    held = data[::5] if len(data) >= 50 else data
    fitted = [d for i, d in enumerate(data) if i % 5] if len(data) >= 50 else data
    model.weights, model.bias = fit_ftrl(fitted, len(langs), dim=dim)
    logits = np.array([v @ model.weights[at] + model.bias for _, at, v in held])
    classes = np.array([y for y, *_ in held])
    model.temperature = fit_temperature(logits, classes)
    if held is not data:
        p = _softmax(logits / model.temperature)
        right = p.argmax(1) == classes
        model.min_score = least_score(p.max(1)[right], len(langs))
    else:  # scores of rows that were learned from tell nothing
        model.min_score = least_score(np.zeros(0), len(langs))
    return model


def identify(docs: DataFrame, model: Model, lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """Add the predicted language of each whole text and its calibrated probability; reads no column but text.

    Null and empty texts and texts without a letter: und, 0. Of equal scores the first language in the alphabet. Repeated
    rows give repeated rows, an empty table an empty one. Columns of the same names (in any case) are replaced, others pass
    through.
    """
    docs = without(docs, lang_column, score_column)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WEIGHTS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, lang_column, score_column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_column, T.StringType()), T.StructField(score_column, T.DoubleType())]))


def held_out():
    """True for the fold that nothing is learned from; a null doc_id counts as the text `null`."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 4 == 2


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()))


def keep_identified(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """Drop the documents without a letter and those whose language stays in doubt (least_score); the columns stay as they are."""
    model = train_on_documents(docs)
    min_score = model.min_score if min_score is None else min_score
    found = identify(docs, model, "__lang_pred", "__score")
    return found.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= min_score)).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train_on_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
