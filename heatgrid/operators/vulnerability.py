"""Vulnerability index and paired scenario comparison.

Ranks, quantiles and buckets come from `order`, so that no task sees all units; nulls are neither ranked nor counted.
"""

from __future__ import annotations

import operator
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.operators import order


def with_percent_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Add the percent rank among the values that are not null."""
    return order.with_ranks(df, value, by, percent=out)





def with_bucket(df: DataFrame, value: str, n: int, key: str, out: str) -> DataFrame:
    """Add buckets of equal counts, ties by key; nulls have none."""
    known, unknown = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    placed = order.with_places(known, [value, key], out="__place").crossJoin(F.broadcast(known.agg(F.count("*").alias("__total"))))  # one row
    placed = placed.withColumn(out, order.buckets(F.col("__place"), F.col("__total"), n)).drop("__place", "__total")
    return placed.unionByName(unknown.withColumn(out, F.lit(None).cast("int")))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add z_<column> by one aggregate row that is joined back."""
    stats = df.agg(*[f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(f"z_{c}") for c in columns])


def row_mean(columns: list[str]) -> Column:
    """Mean of the values that are not null; null if all are."""
    known = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def row_sum(columns: list[str]) -> Column:
    """Sum of the values that are not null; 0 if all are null."""
    return F.aggregate(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def quantile_bins(df: DataFrame, outs: dict[str, tuple[str, bool]], n: int) -> DataFrame:
    """Add bins 1..n of values (out: value, rank_fallback): right-closed, the least value in the first; bins end at type-7 quantiles.

    Where breaks coincide: bins of percent ranks (rank_fallback), else as many bins as there are gaps. All values are
    counted in one pass, which gives n + 1 breaks each, and the largest value of each bin of percent ranks.
    """
    values = sorted({v for v, _ in outs.values()})
    long = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").cast("double").alias("x")) for v in values])).alias("__s")).select(F.col("__s.name").alias("__name"), F.col("__s.x").alias("__x"))
    bin_ = F.greatest(F.ceil(F.round(order.percent_rank() * n, 9)), F.lit(1))
    last = [F.max(F.when(bin_ <= k, F.col("__x"))).alias(f"t{k}") for k in range(1, n)]
    breaks = order.quantile_columns("__x", {f"b{i}": i / n for i in range(n + 1)})
    ends = {r["__name"]: r for r in order.counted(long, "__x", ["__name"]).groupBy("__name").agg(*breaks, *last).collect()}  # a row a value, 2 n numbers
    added = {}
    for out, (value, rank_fallback) in outs.items():
        row = ends.get(value)
        edges = sorted({row[f"b{i}"] for i in range(n + 1)}) if row else []
        if rank_fallback and row and len(edges) < n + 1:
            edges = [row["b0"] - 1, *[row[f"t{k}"] for k in range(1, n)]]
        own = F.col(f"`{value}`")
        below = F.size(F.filter(F.array(*map(F.lit, edges)), partial(operator.gt, own))) if edges else F.lit(0)
        added[out] = F.when(own.isNotNull(), F.greatest(below, F.lit(1)))
    return df.withColumns(added)


def quantile_bin(df: DataFrame, value: str, n: int, out: str, rank_fallback: bool = True) -> DataFrame:
    """Add the bins of one value."""
    return quantile_bins(df, {out: (value, rank_fallback)}, n)


def index(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Percent rank of each metric, their mean as the score, its percent rank and its rank from the top."""
    long = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "__metric", "__measure")
    pct = with_percent_rank(long, "__measure", "__pct", ["__metric"])
    out = pct.groupBy(key).pivot("__metric", metrics).agg(F.first("__pct")).withColumnsRenamed({m: f"p_{m}" for m in metrics})
    return with_score_ranks(out.withColumn("score", row_mean([f"p_{m}" for m in metrics])))


def with_score_ranks(df: DataFrame) -> DataFrame:
    """Add the percent rank of the score and its rank from the top."""
    return order.with_ranks(df.drop("score_pct", "score_rank"), "score", percent="score_pct", dense_desc="score_rank")


def rolled_up(index_: DataFrame, areas: DataFrame, key: str, area: str) -> DataFrame:
    """Mean score of each area (not weighted), ranked again."""
    return with_score_ranks(index_.join(areas.select(key, area), key).groupBy(area).agg(F.avg("score").alias("score"), F.count("*").alias("units")))


def quantile_trim(long: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows (metric, value) within the percentiles of their metric, both ends included."""
    ends = order.quantiles(long, "value", {"__lo": low, "__hi": high}, ["metric"])
    return long.join(ends, "metric").where(F.col("value").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def pairing_violations(df: DataFrame, key: str, scenarios: list[str]) -> DataFrame:
    """Keys with other than one row for each of the scenarios: (key, scenario, n)."""
    n = df.where(F.col("lc_scenario").isin(scenarios)).groupBy(key).pivot("lc_scenario", scenarios).count().na.fill(0)
    return n.unpivot([key], scenarios, "lc_scenario", "n").where("n <> 1")


def paired(df: DataFrame, key: str, first: str, second: str, others: list[str]) -> DataFrame:
    """A row per key with both scenarios' cases (null ones go) and their difference."""
    out = df.groupBy(key, *others).pivot("lc_scenario", [first, second]).agg(F.first("cases"))
    out = out.withColumnsRenamed({first: "cases_first", second: "cases_second"}).where("cases_first IS NOT NULL AND cases_second IS NOT NULL")
    return out.withColumn("delta_cases", F.col("cases_second") - F.col("cases_first"))


def benefit_classes(pairs: DataFrame) -> DataFrame:
    """Low, Moderate or High by the tertiles of the first scenario, for both; equal tertiles give null classes."""
    cuts = order.quantiles(pairs, "cases_first", {"__a": 1 / 3, "__b": 2 / 3})
    out = pairs.crossJoin(F.broadcast(cuts))  # one row
    named = lambda c: F.when(F.col("__a") < F.col("__b"), F.when(F.col(c) <= F.col("__a"), "Low").when(F.col(c) <= F.col("__b"), "Moderate").otherwise("High"))
    return out.withColumns({"benefit_first": named("cases_first"), "benefit_second": named("cases_second")}).drop("__a", "__b")


def vulnerable(classed: DataFrame, key: str, metrics: list[str], population: str | None = None) -> DataFrame:
    """Long by metric: percent rank of the vulnerability, and whether it is in the upper third; unknown ones go."""
    weight = F.col(population).cast("double") if population else F.lit(1.0)
    own = classed.withColumns({"population": weight, **{m: F.col(m).cast("double") for m in metrics}})
    out = own.unpivot([key, "population", "cases_first", "cases_second", "delta_cases", "benefit_first", "benefit_second"], metrics, "metric", "vulnerability").where("vulnerability IS NOT NULL")
    return with_percent_rank(out, "vulnerability", "pct", ["metric"]).withColumn("high", F.col("pct") >= 2 / 3)


def weighted_share(condition: Column, weight: Column) -> Column:
    """Share of the weights for which a condition holds."""
    return F.sum(F.when(condition, weight).otherwise(0.0)) / F.sum(weight)


def headline(long: DataFrame) -> DataFrame:
    """Among the highly vulnerable: counts and shares of low benefit in both scenarios, cases resolved and new, deaths averted."""
    a, b = F.col("benefit_first") == "Low", F.col("benefit_second") == "Low"
    n_a = F.count_if(a)
    return long.where("high").groupBy("metric").agg(
        F.count("*").alias("n_high"), F.sum("population").alias("population_high"), n_a.alias("n_low_first"), F.count_if(b).alias("n_low_second"),
        (100 * n_a / F.count("*")).alias("pct_low_first"), (100 * F.count_if(b) / F.count("*")).alias("pct_low_second"),
        (100 * (F.count_if(b) - n_a) / F.count("*")).alias("change_points"), F.count_if(a & ~b).alias("n_resolved"),
        F.when(n_a > 0, 100 * F.count_if(a & ~b) / n_a).alias("pct_resolved"), F.count_if(~a & b).alias("n_new"), F.sum("delta_cases").alias("deaths_averted_more"),
        (100 * (F.sum("cases_second") / F.sum("cases_first") - 1)).alias("pct_change_averted"),
        (100 * weighted_share(a, F.col("population"))).alias("population_pct_first"), (100 * weighted_share(b, F.col("population"))).alias("population_pct_second"),
    )


def citywide(pairs: DataFrame) -> DataFrame:
    """Deaths averted in both scenarios, their difference, and how much the second retains."""
    a, b = F.sum("cases_first"), F.sum("cases_second")
    return pairs.agg(a.alias("first"), b.alias("second"), (b - a).alias("difference"), (100 * b / a).alias("retention_pct"))


def transitions(long: DataFrame) -> DataFrame:
    """Highly vulnerable units by metric and pair of classes, with their share of the metric's; pairs without units have 0."""
    n = long.where("high").groupBy("metric", "benefit_first", "benefit_second").agg(F.count("*").alias("n"))
    levels = F.array(*map(F.lit, ("Low", "Moderate", "High")))
    grid = n.select("metric").distinct().select("metric", F.explode(levels).alias("benefit_first")).select("*", F.explode(levels).alias("benefit_second"))
    out = grid.join(n, ["metric", "benefit_first", "benefit_second"], "left").na.fill(0, ["n"])
    return out.withColumn("pct", share_of_group("n", ["metric"]))


def share_of_group(value: str, by: list[str]) -> Column:
    return 100 * F.col(value) / F.sum(value).over(Window.partitionBy(*by))


def bivariate_counts(df: DataFrame, x: str, y: str, n: int = 3) -> DataFrame:
    """Units by joint class of two values in n bins each, and their share of all."""
    out = quantile_bins(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), {"__x": (x, False), "__y": (y, False)}, n)
    counts = out.groupBy(F.concat_ws("-", "__x", "__y").alias("bi_class")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # n * n rows
