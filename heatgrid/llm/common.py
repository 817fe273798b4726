"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of more rows than this, and than their share of all, are dealt over several tasks; so hot keys are MAX_HOT at most.
HOT_ROWS, MAX_HOT = 1000, 100_000
#: Tables of a few numbers a row are broadcast up to this many rows, as counted.
MAX_BROADCAST_ROWS = 200_000

#: ASCII white space, the set written `[\x20\x09-\x0D]` in the contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows of texts that a task of Python holds as objects at once.
ROWS_AT_ONCE = 500


def portions(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most `rows` rows: a batch has up to 10,000 texts, which take several times their bytes as objects."""
    for whole in batches:
        for at in range(0, len(whole), rows):
            yield whole.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (any store Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, as in tests, one of our own, but on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        return current.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: list[list[str]] = []


@contextmanager
def intermediates() -> Iterator[list[str]]:
    """The paths that materialise() writes inside of a with-block, in order, for who knows when they are no longer asked for."""
    _WRITTEN.append([])
    try:
        yield _WRITTEN[-1]
    finally:
        made = _WRITTEN.pop()
        if _WRITTEN:
            _WRITTEN[-1].extend(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables from the shared folder, through Spark's own file system."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until the caller removes it: results of operators read such tables, so that they can go when the
    results have been written (intermediates, remove).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """withColumns, where an input column of the same name in any case gives way."""
    names = {c.lower() for c in columns}
    clash = [c for c in df.columns if c.lower() in names and c not in columns]
    return df.drop(*clash).withColumns(columns)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names clash (in any case) with those an operator adds."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bounded(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it was counted to be small; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def join_dealt(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join with a table that has one row a key and, in the column `rows`, how many rows of `left` have it.

    Keys of more than HOT_ROWS rows and more than total / MAX_HOT are dealt over tasks by a hash of the left row, with a
    copy of the right row for each; as `rows` adds up to `total` at most, there are MAX_HOT such keys at most. The column
    `rows` goes.
    """
    share = max(HOT_ROWS, -(-total // MAX_HOT))
    hot = right.where(F.col(rows) > share).select(F.col(key).alias("__hot"), F.ceil(F.col(rows) / share).cast("int").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1))
    own = F.xxhash64(*[F.col(c) for c, t in left.dtypes if "map<" not in t])
    left = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(own, salts).cast("int")).drop("__hot", "__salts")
    right = right.withColumn("__salts", F.ceil(F.greatest(F.col(rows), F.lit(1)) / share).cast("int")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop(rows, "__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")
