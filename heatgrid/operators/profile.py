"""Table profiles, tidying and set operations."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.operators import order
from heatgrid.sources.sinks import parquet, scratch


def select_matching(df: DataFrame, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Columns whose names match, without those that match the other pattern."""
    return df.select(*[c for c in df.columns if (not keep or re.search(keep, c)) and not (drop and re.search(drop, c))])


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names get _1, _2 ... in order; a name that is taken is passed over."""
    seen: dict[str, int] = {}
    taken, out = set(df.columns), []
    for c in df.columns:
        if c in seen:
            while f"{c}_{seen[c]}" in taken:
                seen[c] += 1
            out.append(f"{c}_{seen[c]}")
            taken.add(out[-1])
        else:
            out.append(c)
        seen[c] = seen.get(c, 0) + 1
    return df.toDF(*out)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent of each value; nulls are Unknown."""
    n = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias(column)).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a value


#: Different values of a column that a task counts at once.
COUNTERS = 10_000
#: Values of a column that are counted by a broadcast.
MAX_CANDIDATES = 100_000


def _candidates(df: DataFrame, columns: list[str], counters: int) -> DataFrame:
    """(name, value, least, missed) of the values of each column that a task's bounded counters still hold at its end.

    A task holds at most `counters` values a column, with how often they came at least. Where a new one finds no room, all
    counts are lowered by the (counters + 1)-th largest of them, and those that reach 0 go; by how much in all a task has
    lowered them is the most that it can have missed of any value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in columns]
        missed = [0] * len(columns)
        for batch in batches:
            for k in range(len(columns)):
                own = pa.chunked_array([batch.column(k)]).value_counts()
                held[k].update(dict(zip(own.field("values").to_pylist(), own.field("counts").to_pylist(), strict=True)))
                if len(held[k]) > counters:
                    cut = heapq.nlargest(counters + 1, held[k].values())[-1]
                    missed[k] += cut
                    held[k] = Counter({v: n - cut for v, n in held[k].items() if n > cut})
        for k, own in enumerate(held):
            rows = [*own.items(), (None, 0)]  # the last row carries what was missed, where nothing is held too
            yield pa.RecordBatch.from_arrays([pa.array([columns[k]] * len(rows), pa.string()), pa.array([v for v, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64()), pa.array([0] * len(own) + [missed[k]], pa.int64())], ["name", "value", "least", "missed"])

    found = df.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, "name string, value string, least long, missed long")
    return found.groupBy("name", "value").agg(F.sum("least").alias("least"), F.sum("missed").alias("missed"))


def top_values(df: DataFrame, columns: list[str], k: int = 10, counters: int = COUNTERS) -> DataFrame:
    """The k most frequent values of each column, nulls among them; ties by value.

    Tasks hand on the values that their bounded counters hold, so that what is shuffled does not follow the different
    values. Where no task had to let go, these counts are whole. Else a value has been missed as often as the tasks can
    have missed any at most: where k values come more often than that, no other can be among the first k, and the table is
    read again to count just those that can. Columns without such values, as keys, are counted whole.
    """
    own = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    ranked = lambda n: n.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("place") <= k)
    counted = lambda names: own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in names])).alias("s")).select("s.name", "s.value")
    found = parquet(_candidates(own, columns, counters), f"{scratch(df.sparkSession)}/candidates")
    missed = found.groupBy("name").agg(F.sum("missed").alias("missed"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("least")))
    floor = found.withColumn("place", place).where(F.col("place") == k).select("name", F.col("least").alias("floor"))
    bounds = missed.join(floor, "name", "left")
    fits = found.select("name", "value", "least").join(bounds, "name").where((F.col("missed") > 0) & (F.col("floor") > F.col("missed")) & (F.col("least") + F.col("missed") >= F.col("floor")))
    sizes = {r["name"]: r["count"] for r in fits.groupBy("name").count().collect()}  # a row a column
    whole = [r["name"] for r in missed.where("missed = 0").collect()]
    sure = [c for c in columns if 0 < sizes.get(c, 0) <= MAX_CANDIDATES]
    rest = [c for c in columns if c not in whole and c not in sure]
    parts = [found.where(F.col("name").isin(whole) & (F.col("least") > 0)).select("name", "value", F.col("least").alias("n"))]
    if sure:
        few = fits.where(F.col("name").isin(sure)).select(F.col("name").alias("__name"), F.col("value").alias("__value"))
        met = counted(sure).join(F.broadcast(few), (F.col("name") == F.col("__name")) & F.col("value").eqNullSafe(F.col("__value")))
        parts.append(met.groupBy("name", "value").agg(F.count("*").alias("n")))
    if rest:
        parts.append(counted(rest).groupBy("name", "value").agg(F.count("*").alias("n")))
    return ranked(reduce(DataFrame.unionByName, parts))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, known, missing and percent missing of each column."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    out = counts.unpivot(["__n"], columns, "name", "missing")
    return out.select("name", F.col("__n").alias("n"), (F.col("__n") - F.col("missing")).alias("known"), "missing", F.when(F.col("__n") > 0, 100 * F.col("missing") / F.col("__n")).alias("pct_missing"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def group_count(keys: list[str], counted: str | None = None) -> Column:
    """Number of rows (or known values) of a row's group."""
    return F.count(F.col(counted) if counted else F.lit(1)).over(Window.partitionBy(*keys))


def bin_counts(df: DataFrame, value: str, low: float, width: float) -> DataFrame:
    """Rows and mean of each right-closed bin."""
    bin_ = F.ceil((F.col(value) - low) / width) - 1
    return df.where(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).withColumn("from", low + F.col("bin") * width)


def cumulative_share(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Add the empirical distribution from 0 to 1."""
    return order.with_ranks(df, value, by, percent=out)


def with_row_ids(df: DataFrame, by: list[str], out: str = "row_id") -> DataFrame:
    """Add the number 1, 2 ... of each row in an order that tells rows apart."""
    return order.with_places(df, by, out=out)


def sample_per_layer(df: DataFrame, layer: str, n: int, seed: int = 42) -> DataFrame:
    """At most n random rows of each layer; of large layers about twice as many are drawn first, so that few are ranked."""
    counts = df.groupBy(F.col(layer).alias("__layer")).agg(F.count("*").alias("__count"))
    drawn = df.withColumn("__r", F.rand(seed)).join(counts, F.col(layer).eqNullSafe(F.col("__layer"))).where(F.col("__r") * F.col("__count") <= 2 * n + 100)
    return drawn.withColumn("__n", F.row_number().over(Window.partitionBy(layer).orderBy("__r"))).where(F.col("__n") <= n).select(*df.columns)


def export_safe(df: DataFrame, reserved: tuple[str, ...] = ("fid", "geom", "geometry")) -> DataFrame:
    """Columns that any table format takes: reserved names get _1, nested values are JSON, dates text, truth values 0 and 1."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("byte")
        out.append(c.alias(f"{f.name}_1" if f.name.lower() in reserved else f.name))
    return df.select(*out)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the sorted different values, codes from 0."""
    different = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return order.running(different, ["value"], out="code").withColumn("code", F.col("code").cast("int"))


def encoded(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The column replaced by its code; null stays null."""
    return df.join(table.withColumnRenamed("value", column), column, "left").drop(column).withColumnRenamed("code", f"{column}_code")


def unmatched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table does not have (J4); null keys match nothing."""
    return df.join(other.select(*keys), keys, "left_anti")


def members(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table has (J5), each once."""
    return df.join(other.select(*keys), keys, "left_semi")


def set_operation(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Different rows of both (intersect), of the first alone (subtract), or of either (union)."""
    return {"intersect": a.intersect, "subtract": a.subtract, "union": lambda x: a.unionByName(x).distinct()}[kind](b)
