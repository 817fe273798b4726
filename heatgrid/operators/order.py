"""Order statistics and ranks of tables of any size.

Rows are dealt over ranges of the order, each range is summed by a task of its own, and the sums of the ranges before it
are added: no task sees all rows, and none sees all of a group. Values that recur are counted before they are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.sources.sinks import parquet, scratch


#: Ranges of values at most; places among them are looked up by halves.
MAX_RANGES = 4096
#: A value of more rows than this is dealt over tasks where ranks return to rows; so such values are one in HOT_ROWS rows at most.
HOT_ROWS = 1_000_000

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def _refuse_taken(df: DataFrame, *names: str | None) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names if n}
    if taken:
        raise ValueError(f"columns that the table already has: {sorted(taken)}")


def running(df: DataFrame, order: list[str], by: list[str] | None = None, weight: str | None = None, out: str = "before", rows: str | None = None) -> DataFrame:
    """Add the sum of `weight` (1 where none is named) over the rows of the same `by` that come earlier in `order`, and their number.

    by and order tell rows apart; rows they do not tell apart come in any order. Nulls come first, as a group too. Ranges
    are written once in the shared folder, so that all that follows sees the same ones. Names of columns that df has are
    refused for what is added.
    """
    by = by or []
    _refuse_taken(df, out, rows)
    ranged = df.repartitionByRange(*by, *order) if df.columns else df
    own = parquet(ranged.withColumn("__range", F.spark_partition_id()), f"{scratch(df.sparkSession)}/ranges")
    return _summed(own, order, by, F.col(weight) if weight else F.lit(1), {"__before": out, "__earlier": rows}).select(*df.columns, out, *([rows] if rows else []))


def _summed(own: DataFrame, order: list[str], by: list[str], weight: Column, names: dict[str, str | None]) -> DataFrame:
    """Sums over earlier rows of rows dealt over ranges (__range): within a range by a window, of earlier ranges from a row a range.

    names: __before, the weights of earlier rows; __earlier, their number; __total and __all, both of the whole group.
    """
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a row a range, and one more for each group that ends in it
    sums = own.groupBy(*by, "__range").agg(F.sum(weight).alias("__sum"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.col("__range").alias("__in"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first"),
        F.sum("__sum").over(whole).alias("__group_sum"), F.sum("__rows").over(whole).alias("__group_rows"),
    )
    on = F.col("__range") == F.col("__in")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"__{i}"))
    placed = own.withColumns({"__here": F.coalesce(F.sum(weight).over(inside), F.lit(0)), "__nth": F.count(F.lit(1)).over(inside)}).join(sums, on)
    values = {"__before": F.col("__start") + F.col("__here"), "__earlier": F.col("__first") + F.col("__nth"), "__total": F.col("__group_sum"), "__all": F.col("__group_rows")}
    return placed.withColumns({name: values[k] for k, name in names.items() if name})


def _place_among(value: Column, cuts: Column, most: int) -> Column:
    """How many of the sorted cuts are not above a value, by halves."""
    steps = F.array(*[F.lit(1 << b) for b in range(most.bit_length() - 1, -1, -1)])
    fits = lambda at: (at <= F.size(cuts)) & (F.get(cuts, at - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def counted(df: DataFrame, value: str, by: list[str] | None = None, n: Column | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """The different known values of each group: (by, value, __n, __before, __smaller, __total, __different), and aggregates of their rows (also).

    How often they come, how many rows and how many values of the group are smaller, and how many rows and different
    values it has; rows that stand for several come with their sum as n. The counts are written once in the shared folder,
    so that the table is read once for them however often they are asked for. Numbers and dates are dealt over ranges
    between approximate quantiles of the counts, other values are ranged by a sort.
    """
    by = by or []
    also = also or {}
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count("*") if n is None else n).alias("__n"), *[c.alias(k) for k, c in also.items()])
    names = {"__before": "__before", "__earlier": "__smaller", "__total": "__total", "__all": "__different"}
    kind = dict(df.dtypes)[value]
    if kind not in _NUMBERS and not kind.startswith("decimal"):
        ranged = counts.repartitionByRange(*by, value).withColumn("__range", F.spark_partition_id())
        own = parquet(ranged, f"{scratch(df.sparkSession)}/ranges")
    else:
        ranges = min(MAX_RANGES, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        number = F.col(value).cast("timestamp").cast("double") if kind == "date" else F.col(value).cast("double")
        counts = parquet(counts, f"{scratch(df.sparkSession)}/counts")
        if ranges > 1:
            cuts = counts.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("__cuts"))
            own = counts.crossJoin(F.broadcast(cuts))  # one row
            own = own.withColumn("__range", F.coalesce(_place_among(number, F.col("__cuts"), ranges), F.lit(0))).drop("__cuts")
        else:
            own = counts.withColumn("__range", F.lit(0))
    return _summed(own, [value], by, F.col("__n"), names).select(*by, value, "__n", *names.values(), *also)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (type 7) of each group; null for groups without a known value."""
    by = by or []
    found = quantiles_of(counted(df, value, by), value, shares, by)
    if not by:
        return found
    groups = df.select(*by).distinct().select(*[F.col(c).alias(f"__g_{c}") for c in by])
    on = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by]
    return groups.join(found, on, "left").select(*[F.col(f"__g_{c}").alias(c) for c in by], *shares)


def quantile_columns(value: str, shares: dict[str, float]) -> list[Column]:
    """Aggregates over what was counted that give quantiles: the value at a place is the largest with no more rows before it."""
    at = lambda h: F.max(F.when(F.col("__before") <= h, F.col(value)))
    out = []
    for name, p in shares.items():
        h = (F.col("__total") - 1) * F.lit(float(p))
        low, high, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        out.append((low + (high - low) * part).alias(name))
    return out


def quantiles_of(counts: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """The quantiles of what was counted."""
    return counts.groupBy(*(by or [])).agg(*quantile_columns(value, shares))


def percent_rank() -> Column:
    """Of a value that was counted."""
    return F.when(F.col("__total") > 1, F.col("__before") / (F.col("__total") - 1)).otherwise(0.0)


def with_ranks(df: DataFrame, value: str, by: list[str] | None = None, percent: str | None = None, dense_desc: str | None = None) -> DataFrame:
    """Add percent ranks and ranks from the top (1, 2 ... without gaps) of the known values; null ones have none.

    Ranks return to rows by value; a value of very many rows is dealt over tasks.
    """
    by = by or []
    _refuse_taken(df, percent, dense_desc)
    own = counted(df, value, by).select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col(value).alias("__value"), percent_rank().alias("__percent"), (F.col("__different") - F.col("__smaller")).cast("int").alias("__dense"), F.ceil(F.col("__n") / HOT_ROWS).cast("int").alias("__salts"))
    own = parquet(own, f"{scratch(df.sparkSession)}/ranks")
    keys = ["__value", *[f"__r_{c}" for c in by]]
    added = {name: F.col(c) for name, c in ((percent, "__percent"), (dense_desc, "__dense")) if name}

    def on(suffix: str) -> Column:
        same = F.col(value) == F.col(f"__value{suffix}")
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"__r_{c}{suffix}"))
        return same

    hot = own.where(F.col("__salts") > 1).select(*[F.col(k).alias(f"{k}_hot") for k in keys], F.col("__salts").alias("__dealt"))
    if hot.isEmpty():
        return df.join(own, on(""), "left").withColumns(added).select(*df.columns, *added)
    dealt = df.join(F.broadcast(hot), on("_hot"), "left")
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]), F.coalesce("__dealt", F.lit(1))).cast("int")).drop(*[f"{k}_hot" for k in keys], "__dealt")
    own = own.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
    return dealt.join(own, on("") & (F.col("__salt") == F.col("__copy")), "left").withColumns(added).select(*df.columns, *added)


def with_places(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "place") -> DataFrame:
    """Add the place 1, 2 ... of each row in its group's order; a name that df has is refused."""
    placed = running(df, order, by, None, out)
    return placed.withColumn(out, F.col(out) + 1)


def buckets(place: Column, total: Column, n: int) -> Column:
    """Bucket 1..n of a place among `total`, sizes as equal as can be, the first ones larger."""
    size, more = F.floor(total / n), total % n
    wide = more * (size + 1)
    return F.when(place <= wide, F.ceil(place / (size + 1))).otherwise(more + F.ceil((place - wide) / size)).cast("int")
