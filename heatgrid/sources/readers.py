"""Readers (S1-S8, S12, S13): Spark's own sources with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.functions.text import key_values
from heatgrid.operators.grid import mask_nodata
from heatgrid.operators.profile import lower_names


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def csv_files(spark: SparkSession, pattern: str, schema: str, tags: dict[str, tuple[str, int]] | None = None, glob: str | None = None, by_path: bool = False) -> DataFrame:
    """All CSV files of a pattern in one table, with columns read from their names (or whole paths): tag -> (pattern, group)."""
    reader = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", by_path)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).csv(pattern)
    rows = rows.withColumn("file", F.col("_metadata.file_path") if by_path else file_name())
    return rows.withColumns({t: F.nullif(F.regexp_extract("file", form, group), F.lit("")) for t, (form, group) in (tags or {}).items()})


def find_files(spark: SparkSession, folder: str, glob: str = "*", any_of: list[str] | None = None, none_of: list[str] | None = None) -> DataFrame:
    """(path, length) of the files below a folder whose names match, by tokens of their paths (S8); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length")
    has = lambda tokens: reduce(lambda a, b: a | b, [F.contains("path", F.lit(t)) for t in tokens])
    files = files.where(has(any_of)) if any_of else files
    return files.where(~has(none_of)) if none_of else files


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated values with a header; names in lower case, all text unless a schema is given."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return lower_names((reader.schema(schema) if schema else reader).csv(path))


def csv_after_preamble(spark: SparkSession, path: str, columns: dict[str, str], skip: int) -> DataFrame:
    """CSV files whose first `skip` lines (and a header line) say something else; values that do not parse are null.

    Files are split as any text is: lines are numbered in the split that starts a file, which holds its preamble.
    """
    place = {"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start")}
    lines = spark.read.text(path).select("value", *[c.alias(k) for k, c in place.items()]).withColumn("__i", F.monotonically_increasing_id())
    firsts = lines.where("__at = 0").groupBy("__file").agg(F.min("__i").alias("__first"))  # a row a file
    body = lines.join(firsts, "__file").where((F.col("__at") > 0) | (F.col("__i") - F.col("__first") > skip)).where("trim(value) <> ''")
    fields = F.from_csv("value", ", ".join(f"`{c}` string" for c in columns))
    return body.select(fields.alias("f")).select(*[F.col(f"f.{c}").try_cast(t).alias(c) for c, t in columns.items()])


def multiline_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with line ends inside of quoted values."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A Parquet feature table, of which only these columns are read."""
    return spark.read.parquet(path).select(*columns)


def cells(spark: SparkSession, path: str, layers: list[str] | None = None, nodata: float | None = None) -> DataFrame:
    """A Parquet cell table (layer, row, col, value), its nodata null."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("layer").isin(layers)) if layers else rows
    return rows.withColumn("value", mask_nodata(F.col("value"), nodata))


def causes(spark: SparkSession, path: str) -> DataFrame:
    """Causes of death from a JSON file."""
    return spark.read.schema("name string, rr_1c double, rr_low_1c double, rr_high_1c double").option("multiLine", True).json(path)


def key_value_lines(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Columns from lines of `key: value` pairs; missing keys are null."""
    return spark.read.text(path).select(key_values(F.col("value")).alias("m")).select(*[F.try_element_at("m", F.lit(k)).alias(k) for k in keys])


def image_metadata(texts: DataFrame, column: str = "json") -> DataFrame:
    """Status, date, id and place out of JSON texts; those without an image go."""
    schema = "status string, date string, pano_id string, location struct<lat: double, lng: double>"
    own = texts.withColumn("m", F.from_json(column, schema)).where("m.status = 'OK'")
    return own.select("m.status", "m.date", "m.pano_id", "m.location.lat", "m.location.lng")
