"""Sinks (S5, S9, S10, S12)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a columnar layer and read it back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def csv_with_totals(df: DataFrame, path: str, label: str, about: dict[str, str]) -> DataFrame:
    """CSV of a table and a row of totals of its numbers; what it is about goes beside it as JSON."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    total = df.agg(*[F.sum(c).alias(c) for c in numbers]).withColumn(label, F.lit("Total"))
    out = df.unionByName(total, allowMissingColumns=True)
    csv(out, path)
    run_configuration(df, about, path.rstrip("/") + "_about")
    return out


def run_configuration(df: DataFrame, about: dict[str, str], path: str) -> None:
    """A run's settings as one JSON row."""
    row = df.sparkSession.range(1).select(*[F.lit(str(v)).alias(k) for k, v in about.items()])
    row.coalesce(1).write.mode("overwrite").json(path)


_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir. Where that is unset, as in tests, a temporary one, but on one machine only.

    It stays until clear_scratch, as results read what is in it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    _SCRATCH.append(f"{base.rstrip('/')}/heatgrid-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that operators wrote on their way in this process; for when their results have been written."""
    while _SCRATCH:
        place = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
