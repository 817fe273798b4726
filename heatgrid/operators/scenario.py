"""Scenario tables in long form (unit, year, lc_scenario, value): changes, summaries, pivots."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.operators import order


def within_year_change(long: DataFrame, baseline: str, unit: str = "unit", value: str = "value") -> DataFrame:
    """Add change = value less the baseline scenario's value of the same year and unit; null without one."""
    own = Window.partitionBy("year", unit)
    return long.withColumn("change", F.col(value) - F.max(F.when(F.col("lc_scenario") == baseline, F.col(value))).over(own))


def change_from(long: DataFrame, year: int, scenario: str, unit: str = "unit", value: str = "value") -> DataFrame:
    """Add change = value less the unit's value in a fixed year and scenario; units without it go."""
    base = long.where((F.col("year") == year) & (F.col("lc_scenario") == scenario)).select(unit, F.col(value).alias("__base"))
    return long.join(base, unit).withColumn("change", F.col(value) - F.col("__base")).drop("__base")


def combined_effects(land_cover: DataFrame, climate: DataFrame, drop_year: int) -> DataFrame:
    """Both kinds of change in one table, labelled, without the first year."""
    parts = land_cover.withColumn("label", F.lit("lc effect")), climate.withColumn("label", F.lit("climate+lc effect"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).where(F.col("year") != drop_year)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (with null values too), mean, sample deviation, standard error and normal interval of each group."""
    n = F.count(F.lit(1))
    out = df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.withColumns({"se": se, "ci_low": F.col("mean") - 1.96 * se, "ci_high": F.col("mean") + 1.96 * se})


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation of each group."""
    shares = shares or {"p2_5": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p97_5": 0.975}
    return order.quantiles(df, value, shares, keys)


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, p80, p90, interquartile range, and the upper whisker's end of each group."""
    out = quantiles(df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p80": 0.8, "p90": 0.9})
    return out.withColumns({"iqr": F.col("p75") - F.col("p25"), "upper": F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))})


def numeric_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means of all numeric columns that are no keys."""
    own = [c for c, t in df.dtypes if c not in keys and (t in ("double", "float", "int", "bigint", "smallint") or t.startswith("decimal"))]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in own])


def against_baseline(runs: DataFrame, baseline: DataFrame, key: str, value: str = "mean") -> DataFrame:
    """Inner join with suffixes _s and _b and their difference."""
    b = baseline.select(key, F.col(value).alias(f"{value}_b"))
    return runs.withColumnRenamed(value, f"{value}_s").join(b, key).withColumn(f"{value}_diff", F.col(f"{value}_s") - F.col(f"{value}_b"))


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join; a missing side is 0."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = b.join(a, key, "full").na.fill(0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before"))


def ensemble_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over all models of each area, pathway and period."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value), F.count_distinct("model").alias("models"))


def wide(df: DataFrame, keys: list[str], names: str, values: list[str], levels: list | None = None, prefix: str = "") -> DataFrame:
    """Long to wide; several values give columns <level>_<value>."""
    pivoted = df.withColumn(names, F.concat(F.lit(prefix), F.col(names))) if prefix else df
    grouped = pivoted.groupBy(*keys).pivot(names, [f"{prefix}{x}" for x in levels] if levels else None)
    return grouped.agg(*[F.first(v, True).alias(v) for v in values])


def long(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


#: Combinations of keys at most.
MAX_COMBINATIONS = 10_000_000


def completed(df: DataFrame, keys: list[str], fills: dict) -> DataFrame:
    """All combinations of the keys' values; missing rows get the fills. Keys whose values make more than MAX_COMBINATIONS are refused."""
    counts = df.agg(*[F.count_distinct(F.struct(k)).alias(k) for k in keys]).first()
    n = prod(counts[k] for k in keys)
    if n > MAX_COMBINATIONS:
        raise ValueError(f"{n} combinations of {keys}; {MAX_COMBINATIONS} at most")
    grid = df.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(df.select(k).distinct())
    return grid.join(df, keys, "left").na.fill(fills)


def differences(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add name = first column less second, for each pair."""
    return df.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()})


def binned(value: Column, low: float, width: float) -> Column:
    """Number of the right-closed bin of fixed width; values at `low` fall into the first."""
    return F.greatest(F.ceil((value - low) / width) - 1, F.lit(0))
