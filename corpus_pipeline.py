"""The corpus pipeline: language ID, line de-duplication, SimHash near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. run() writes each stage's result as Parquet and reads it again as the next one's docs.

All stages take an empty table (and give one), null and empty and very long texts, null and repeated ids, repeated rows,
and further columns, whatever their names; those pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm import langid, line_dedup, packing, simhash
from heatgrid.llm.common import intermediates, materialise, remove, table

TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: those without a letter (null and empty texts too), and those it has no clear language for.

    The model learns from the labelled rows of docs itself; without any, all go, as there is no language to find. Repeated
    rows stay or go together.
    """
    return langid.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all; n_chars follows the text.

    Each row counts as a document. Null texts stay null; a text may become empty; no row goes.
    """
    cut = line_dedup.drop_common_lines(docs, lines_column="__n_lines", dropped_column="__n_dropped")
    if "n_chars" in docs.columns:
        kept = F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", kept)
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Null and blank texts are a group of their own kind (fingerprint 0). Rows without a doc_id stay; of rows that repeat an
    id each group that it names keeps one.
    """
    return simhash.drop_similar(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed into sequences: a row a piece. A null or empty text is one end token; repeated rows are packed as often as they come."""
    from public_tokenizers import path

    return packing.pack_documents(docs, path(TOKENIZER))


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("simhash_near_dedup", near_dedup), ("best_fit_packing", pack)]

#: SQL has no trained language model, Golay search or tokenizer; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with intermediates() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage wrote on its way, and what it read, is not asked for again
        remove(spark, before + made[:-1])
        before = made[-1:]
    return docs
