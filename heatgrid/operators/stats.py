"""Tests and fits over tables.

Sums, ranks and cross products are Spark aggregates; what is left (tails of distributions, solving k x k systems) runs on
results of a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.operators import order
from heatgrid.sources.sinks import parquet, scratch

# ---- tails of distributions, for result rows


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-30)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-30)
            c = 1 + num / c or 1e-30
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-30)
        c = b + an / c or 1e-30
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _tail(function):
    @F.pandas_udf("double")
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else function(*row) for row in zip(*args, strict=True)], dtype="float64")

    return run


def t_p_value(t: Column, df: Column) -> Column:
    return _tail(lambda t, df: beta_cdf(df / 2, 0.5, df / (df + t * t)))(t.cast("double"), df.cast("double"))


def t_quantile(p: Column, df: Column) -> Column:
    """The t value below which a share p (over a half) lies, by halving."""

    def search(p: float, df: float) -> float:
        low, high = 0.0, 1e6
        for _ in range(200):
            t = (low + high) / 2
            low, high = (t, high) if 1 - beta_cdf(df / 2, 0.5, df / (df + t * t)) / 2 < p else (low, t)
        return (low + high) / 2

    return _tail(search)(p.cast("double"), df.cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    return _tail(lambda f, a, b: beta_cdf(b / 2, a / 2, b / (b + a * f)))(f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi2_p_value(x: Column, df: Column) -> Column:
    return _tail(lambda x, df: gamma_tail(df / 2, x / 2))(x.cast("double"), df.cast("double"))


def z_p_value(z: Column) -> Column:
    return _tail(lambda z: erfc(abs(z) / sqrt(2)))(z.cast("double"))


# ---- comparisons of groups


def _pairs(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """All pairs of a result table's groups, columns with suffixes _a and _b."""
    a = df.select(*by, *[F.col(c).alias(f"{c}_a") for c in df.columns if c not in by])
    b = df.select(*by, *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in by])
    return (a.join(b, by) if by else a.crossJoin(b)).where(F.col(f"{group}_a") < F.col(f"{group}_b"))


def t_tests(df: DataFrame, group: str, value: str, by: list[str] | None = None, equal_var: bool = False) -> DataFrame:
    """t statistic and degrees of freedom of every pair of groups, Welch or pooled."""
    by = by or []
    s = df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    p = _pairs(s, group, by)
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    if equal_var:
        dof = (na + nb - 2).cast("double")
        se = F.sqrt(((na - 1) * va + (nb - 1) * vb) / dof * (1 / na + 1 / nb))
    else:
        se = F.sqrt(va / na + vb / nb)
        dof = F.pow(va / na + vb / nb, 2) / (F.pow(va / na, 2) / (na - 1) + F.pow(vb / nb, 2) / (nb - 1))
    return p.select(*by, f"{group}_a", f"{group}_b", "n_a", "n_b", (F.col("mean_a") - F.col("mean_b")).alias("diff"), ((F.col("mean_a") - F.col("mean_b")) / se).alias("t"), dof.alias("df"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F and degrees of freedom."""
    s = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = s.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    between = F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")
    a, b = F.col("k") - 1, F.col("n") - F.col("k")
    return total.select(a.alias("df1"), b.alias("df2"), ((between / a) / (F.col("within") / b)).alias("f"))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Different values with their count (__ties) and average rank (__rank), within `by`; no row of the table goes through the ranking."""
    n = order.counted(df, value, by)
    return n.select(*(by or []), value, F.col("__n").alias("__ties"), (F.col("__before") + (F.col("__n") + 1) / 2).alias("__rank"))


def _rank_sums(df: DataFrame, group: str, value: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, group, n, rank_sum) and (by, total, tie_term: sum of t^3 - t)."""
    df = df.where(F.col(value).isNotNull()).select(*by, group, F.col(value).alias("__value"))
    own = df.groupBy(*by, group, "__value").agg(F.count("*").alias("__count"))
    ranks = average_ranks(df, "__value", by)
    sums = own.join(ranks, [*by, "__value"]).groupBy(*by, group).agg(F.sum("__count").alias("n"), F.sum(F.col("__count") * F.col("__rank")).alias("rank_sum"))
    t = F.col("__ties").cast("double")
    return sums, ranks.groupBy(*by).agg(F.sum("__ties").alias("total"), F.sum(t * t * t - t).alias("tie_term"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, and degrees of freedom."""
    sums, totals = _rank_sums(df, group, value, [])
    s = sums.agg(F.count("*").alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("r"))
    n = F.col("total").cast("double")
    h = (12 / (n * (n + 1)) * F.col("r") - 3 * (n + 1)) / (1 - F.col("tie_term") / (n * n * n - n))
    return s.crossJoin(totals).select(h.alias("h"), (F.col("k") - 1).alias("df"))  # one row each


def dunn(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Dunn's z of every pair of groups within `by`, and the number of pairs for Bonferroni."""
    by = by or []
    sums, totals = _rank_sums(df, group, value, by)
    p = _pairs(sums.withColumn("mean_rank", F.col("rank_sum") / F.col("n")), group, by)
    p = p.join(totals, by) if by else p.crossJoin(totals)
    n = F.col("total").cast("double")
    se = F.sqrt((n * (n + 1) / 12 - F.col("tie_term") / (12 * (n - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return p.select(*by, f"{group}_a", f"{group}_b", ((F.col("mean_rank_a") - F.col("mean_rank_b")) / se).alias("z"), F.count("*").over(Window.partitionBy(*by)).alias("pairs"))


def bonferroni(p: Column, pairs: Column) -> Column:
    return F.least(p * pairs, F.lit(1.0))


#: Rows of one `by` that are ranked together in a task; equal values stay together.
RANKED_AT_ONCE = 200_000


def _chunk_pairs(group: np.ndarray, place: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(a, b, twice, ties) for each group b of a chunk and all groups a before it: twice W, and what their common values add to the ties.

    Rows are different values (by their place) of groups (by their number) with their counts.
    """
    by_group = np.lexsort((place, group))
    group, n, value = group[by_group], n[by_group], np.unique(place[by_group], return_inverse=True)[1]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for i in range(1, len(starts)):
        at, end = starts[i], starts[i + 1] if i + 1 < len(starts) else len(group)
        here = np.zeros(value.max() + 1, np.int64)
        here[value[at:end]] = n[at:end]
        below, equal = (np.cumsum(here) - here)[value[:at]], here[value[:at]]
        own = n[:at]
        both = 3.0 * own * equal * (own + equal)  # (a + b)^3 - a^3 - b^3
        yield group[starts[:i]], int(group[at]), np.add.reduceat(own * (2 * below + equal), starts[:i]), np.add.reduceat(both, starts[:i])


def rank_sum(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Wilcoxon's W and z (continuity and tie corrected) of every pair of groups, ranked pair by pair; n_a, n_b, and whether values are tied.

    W is how often a value of the first group is above one of the second, ties half. The values of a `by` are dealt in
    their order over chunks: a chunk's own pairs are summed by one task, those of values of different chunks follow from
    the groups' counts. So rows follow the different values of the groups, however many pairs their groups are in.
    """
    by = by or []
    part = by or ["__all"]
    a, b = f"{group}_a", f"{group}_b"
    rows = df if by else df.withColumn("__all", F.lit(0))
    rows = rows.select(*part, F.col(group).alias("__group"), F.col(value).alias("__value")).dropna(subset=[f"`{c}`" for c in (*by, "__group")]).where(F.col("__value").isNotNull())
    own = rows.groupBy(*part, "__group", "__value").agg(F.count("*").alias("__n"))
    t = F.col("__n").cast("double")
    groups = own.groupBy(*part, "__group").agg(F.sum("__n").alias("n"), F.sum(t * t * t - t).alias("ties"))
    groups = parquet(groups.withColumn("__g", F.row_number().over(Window.partitionBy(*part).orderBy("__group"))), f"{scratch(df.sparkSession)}/groups")
    places = order.counted(own, "__value", part, F.sum("__n")).select(*part, "__value", F.col("__before").alias("__place"))
    placed = own.join(places, [*part, "__value"]).join(groups.select(*part, "__group", "__g"), [*part, "__group"])
    placed = parquet(placed.select(*part, F.floor(F.col("__place") / RANKED_AT_ONCE).alias("__chunk"), "__g", "__place", "__n"), f"{scratch(df.sparkSession)}/placed")

    fields = [placed.schema[c] for c in part]
    schema = T.StructType([*fields, T.StructField("__a", T.IntegerType()), T.StructField("__b", T.IntegerType()), T.StructField("__twice", T.LongType()), T.StructField("__ties", T.DoubleType())])

    def inside(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = pa.Table.from_batches(batches)
        for first, second, twice, ties in _chunk_pairs(*(chunk.column(c).to_numpy() for c in ("__g", "__place", "__n"))):
            some = (twice > 0) | (ties > 0)
            size = int(some.sum())
            if size:
                pairs = [pa.array(first[some], pa.int32()), pa.array(np.full(size, second), pa.int32()), pa.array(twice[some], pa.int64()), pa.array(ties[some])]
                yield pa.RecordBatch.from_arrays([*[pa.repeat(k, size) for k in key[: len(part)]], *pairs], schema.names)

    within = placed.groupBy(*part, "__chunk").applyInArrow(inside, schema)
    here = placed.groupBy(*part, "__chunk", "__g").agg(F.sum("__n").alias("__here"))
    cells = here.select(*part, "__chunk").distinct().join(groups.select(*part, "__g"), part).join(here, [*part, "__chunk", "__g"], "left").na.fill(0, ["__here"])
    earlier = Window.partitionBy(*part, "__g").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__earlier", F.sum("__here").over(earlier))
    first = cells.where("__here > 0").select(*part, "__chunk", F.col("__g").alias("__a"), "__here")
    second = cells.where("__earlier > 0").select(*part, "__chunk", F.col("__g").alias("__b"), "__earlier")
    between = first.join(second, [*part, "__chunk"]).where("__a < __b").select(*part, "__a", "__b", (2 * F.col("__here") * F.col("__earlier")).alias("__twice"), F.lit(0.0).alias("__ties"))
    sums = within.union(between).groupBy(*part, "__a", "__b").agg(F.sum("__twice").alias("__twice"), F.sum("__ties").alias("__common"))

    side = lambda name, s: groups.select(*part, F.col("__group").alias(name), F.col("__g").alias(f"__{s}"), F.col("n").alias(f"n_{s}"), F.col("ties").alias(f"__ties_{s}"))
    s = side(a, "a").join(side(b, "b"), part).where("__a < __b").join(sums, [*part, "__a", "__b"], "left")
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    ties = F.col("__ties_a") + F.col("__ties_b") + F.coalesce("__common", F.lit(0.0))
    w = F.coalesce("__twice", F.lit(0)) / 2
    off = w - na * nb / 2
    sigma = F.sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1))))
    return s.select(*by, a, b, w.alias("w"), ((off - F.signum(off) * 0.5) / sigma).alias("z"), "n_a", "n_b", (ties > 0).alias("tied"))


#: From this many values in a group on, or with ties, W is taken as normal.
EXACT_BELOW = 50


@cache
def rank_sum_counts(n: int, m: int) -> np.ndarray:
    """In how many of the ways to mix n values of one group with m of another W is 0, 1 ... n m.

    The largest of all values is of the first group and adds m to W, or of the second and adds nothing; as all groups up
    to n and m are asked for on the way, tables grow group by group. In double precision: 2^53 is passed for groups of
    about 30, where the relative error is that of a rounding a step.
    """
    rows = [np.ones(1) for _ in range(m + 1)]  # no value in the first group
    for i in range(1, n + 1):
        now = [np.ones(1)]
        for j in range(1, m + 1):
            own = np.zeros(i * j + 1)
            own[j:] += rows[j]
            own[: now[-1].size] += now[-1]
            now.append(own)
        rows = now
    return rows[m]


def exact_rank_sum_p(w: float, n: float, m: float) -> float:
    """Two-sided p of W without ties: twice the smaller tail, 1 at most."""
    counts = rank_sum_counts(int(min(n, m)), int(max(n, m)))
    w = int(round(w))
    tail = counts[w:].sum() if w > n * m / 2 else counts[: w + 1].sum()
    return min(1.0, 2 * float(tail / counts.sum()))


def rank_sum_p_value(results: DataFrame) -> Column:
    """p of the rows of rank_sum: exact under EXACT_BELOW values a group without ties, else normal."""
    exact = (F.col("n_a") < EXACT_BELOW) & (F.col("n_b") < EXACT_BELOW) & ~F.col("tied")
    of = lambda c: F.when(exact, results[c]).cast("double")
    return F.coalesce(_tail(exact_rank_sum_p)(of("w"), of("n_a"), of("n_b")), z_p_value(F.when(~exact, results["z"])))


# ---- letters of groups that do not differ


def letter_display(pairs: DataFrame, group: str, p: str = "p", by: list[str] | None = None, level: float = 0.05) -> DataFrame:
    """(by, group, letters) of results of pairs (group_a, group_b, p): two groups share a letter just where they do not differ (p >= level, or null).

    Letters start as one for all groups. A pair that differs splits each letter that both have into one without the first
    and one without the second (insert), and letters whose groups another one has too go (absorb). Letters are named a, b
    ... in order of their first group, after z: aa, ab ... Groups are in order of their names. The results of one `by`
    are a row of a pair of groups, and meet in one task.
    """
    by = by or []
    a, b = f"{group}_a", f"{group}_b"
    rows = F.array_sort(F.collect_list(F.struct(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.coalesce(F.col(p) < level, F.lit(False)).alias("differ"))))

    @F.pandas_udf("array<struct<name:string,letters:string>>")
    def letters(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"name": k, "letters": v} for k, v in compact_letters([(r["a"], r["b"], r["differ"]) for r in own]).items()] for own in groups])

    gathered = pairs.groupBy(*by).agg(rows.alias("__rows")).select(*by, F.explode(letters("__rows")).alias("__l"))
    return gathered.select(*by, F.col("__l.name").alias(group), F.col("__l.letters").alias("letters"))


def compact_letters(pairs: list[tuple[str, str, bool]]) -> dict[str, str]:
    """Letters of the groups of (a, b, whether they differ)."""
    names = sorted({x for p in pairs for x in p[:2]})
    columns = [frozenset(names)]
    for x, y, differ in pairs:
        if differ:
            parts = [q for c in columns for q in ((c - {x}, c - {y}) if x in c and y in c else (c,))]
            parts = sorted(dict.fromkeys(parts), key=len, reverse=True)
            columns = []
            for c in parts:
                if not any(c <= other for other in columns):
                    columns.append(c)
    columns.sort(key=sorted)
    name = lambda i: (name(i // 26 - 1) if i >= 26 else "") + chr(97 + i % 26)
    return {x: "".join(name(i) for i, c in enumerate(columns) if x in c) for x in names}


# ---- association


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of all pairs of columns over the rows without nulls, in one pass; n for the p-value."""
    own = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = own.agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    out = row.unpivot(["n"], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return out.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r", "n")


def correlation_t(r: Column, n: Column) -> Column:
    return r * F.sqrt((n - 2) / (1 - r * r))


def ols(long: DataFrame, by: str = "metric", x: str = "x", y: str = "y") -> DataFrame:
    """Slope, intercept, R squared, standard error and t of y on x for each metric; with_slope_interval adds interval and p."""
    own = long.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    y_, x_ = F.col(y).cast("double"), F.col(x).cast("double")
    s = own.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y_, x_).alias("slope"), F.regr_intercept(y_, x_).alias("intercept"), F.regr_r2(y_, x_).alias("r2"), F.regr_sxx(y_, x_).alias("sxx"), F.regr_syy(y_, x_).alias("syy"))
    se = F.sqrt((F.col("syy") * (1 - F.col("r2"))) / (F.col("n") - 2) / F.col("sxx"))
    return s.withColumn("se", se).withColumn("t", F.col("slope") / F.col("se")).drop("sxx", "syy")


def with_slope_interval(fits: DataFrame) -> DataFrame:
    """Add the two-sided p-value of the slope and its 95 % interval to the result rows of ols."""
    dof = (F.col("n") - 2).cast("double")
    half = t_quantile(F.lit(0.975), dof) * F.col("se")
    return fits.withColumns({"p": t_p_value(F.col("t"), dof), "ci_low": F.col("slope") - half, "ci_high": F.col("slope") + half})


# ---- curves


def _basis(x: Column, lo: Column, hi: Column, k: int) -> list[Column]:
    """k cubic B-splines on even knots over [lo, hi]."""
    u = F.least(F.greatest((x - lo) / (hi - lo) * (k - 3), F.lit(0.0)), F.lit(k - 3 - 1e-9))
    out = []
    for j in range(k):
        d = F.abs(u - (j - 1))
        out.append(F.when(d < 1, 2 / 3 - d * d + d * d * d / 2).when(d < 2, F.pow(2 - d, F.lit(3)) / 6).otherwise(0.0))
    return out


def spline_curves(long: DataFrame, k: int | list[int] = 10, points: int = 100, by: str = "metric", x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """Penalised cubic spline of y on x for each metric: (curve points, fit statistics).

    The cross products of the basis are summed by Spark in one pass per basis size; per metric a k x k system is
    solved for penalties on a grid, and that with the least generalised cross-validation is kept. It is a least-squares
    curve, not a likelihood-fitted additive model.
    """
    spark, sizes = long.sparkSession, [k] if isinstance(k, int) else k
    own = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = own.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi")
    own = own.join(ends, by)  # a row a metric
    curves, fits = [], []
    for size in sizes:
        b = own.select(by, "lo", "hi", "y", *[c.alias(f"b{i}") for i, c in enumerate(_basis(F.col("x"), F.col("lo"), F.col("hi"), size))])
        products = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"p{i}_{j}") for i in range(size) for j in range(i, min(size, i + 4))]
        moments = b.groupBy(by, "lo", "hi").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *[F.sum(F.col(f"b{i}") * F.col("y")).alias(f"q{i}") for i in range(size)], *products)
        for row in moments.collect():  # a row a metric
            curve, fit = _fit(row.asDict(), size, points)
            curves += [(row[by], size, *map(float, c)) for c in curve]
            fits.append((row[by], size, *map(float, fit)))
    curve_type = f"{by} string, k int, x double, fitted double, se double"
    return spark.createDataFrame(curves, curve_type), spark.createDataFrame(fits, f"{by} string, k int, edf double, aic double, aic_linear double, r2_adj double, lambda double")


def _fit(m: dict, k: int, points: int):
    n, q = m["n"], np.array([m[f"q{i}"] for i in range(k)])
    xtx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, min(k, i + 4)):
            xtx[i, j] = xtx[j, i] = m[f"p{i}_{j}"]
    second = np.diff(np.eye(k), n=2, axis=0)
    penalty = second.T @ second
    best = None
    for lam in np.logspace(-6, 6, 49) * max(np.trace(xtx) / k, 1e-12):
        inverse = np.linalg.pinv(xtx + lam * penalty)
        beta = inverse @ q
        edf = float(np.trace(inverse @ xtx))
        rss = max(m["syy"] - 2 * beta @ q + beta @ xtx @ beta, 1e-12)
        gcv = n * rss / max(n - edf, 1e-9) ** 2
        if best is None or gcv < best[0]:
            best = gcv, lam, beta, edf, rss, inverse
    _, lam, beta, edf, rss, inverse = best
    sigma2 = rss / max(n - edf, 1e-9)
    grid = np.linspace(m["lo"], m["hi"], points)
    u = np.minimum((grid - m["lo"]) / (m["hi"] - m["lo"]) * (k - 3), k - 3 - 1e-9)
    d = np.abs(u[:, None] - (np.arange(k) - 1))
    basis = np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
    se = np.sqrt(np.maximum((basis @ inverse * basis).sum(1) * sigma2, 0))
    tss = m["syy"] - m["sy"] ** 2 / n
    # a straight line lies in the basis' span
    line = np.stack([np.ones(k), np.arange(k) - 1.0], 1)
    a = np.linalg.pinv(line.T @ xtx @ line) @ (line.T @ q)
    rss_line = max(m["syy"] - 2 * a @ line.T @ q + a @ line.T @ xtx @ line @ a, 1e-12)
    aic = lambda r, p: n * log(r / n) + 2 * (p + 1)
    r2 = 1 - (rss / max(n - edf, 1e-9)) / (tss / (n - 1)) if tss > 0 and n > 1 else 0.0
    return zip(grid, basis @ beta, se, strict=True), (edf, aic(rss, edf), aic(rss_line, 2), r2, lam)


def compare_fits(fits: DataFrame, by: str = "metric") -> DataFrame:
    """Differences of AIC to the best of each metric, and relative likelihoods."""
    d = F.col("aic") - F.min("aic").over(Window.partitionBy(by))
    return fits.withColumn("delta", d).withColumn("likelihood", F.exp(-d / 2))


def gamma_regression(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Coefficients of a gamma regression with log link on rows with positive y."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    own = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df.where(F.col(y) > 0))
    model = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="__x", labelCol=y, maxIter=50).fit(own)
    rows = [("intercept", float(model.intercept)), *zip(features, map(float, model.coefficients), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def density(df: DataFrame, value: str, points: int = 512, per_bandwidth: int = 20) -> DataFrame:
    """Gaussian density on an even grid, with Silverman's bandwidth.

    Values are counted in bins of a twentieth of the bandwidth first, so that each point sums over bins, not rows.
    """
    s = df.agg(F.min(value), F.max(value), F.stddev_samp(value), F.count(value)).crossJoin(order.quantiles(df, value, {"q1": 0.25, "q3": 0.75})).first()  # one row each
    lo, hi, sd, n, q1, q3 = s
    if not n or lo == hi:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = 0.9 * min(x for x in (sd, (q3 - q1) / 1.34) if x and x > 0) * n**-0.2
    width = h / per_bandwidth
    bins = df.where(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - lo) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    reach = 6 * per_bandwidth
    step = (hi - lo) / (points - 1)
    first, last = F.ceil((F.col("m") - lo - reach * width) / step), F.floor((F.col("m") - lo + reach * width) / step)
    near = bins.withColumn("i", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(points - 1)))))
    x = lo + F.col("i") * step
    u = (x - F.col("m")) / h
    return near.groupBy(x.alias("x")).agg((F.sum(F.col("n") * F.exp(-u * u / 2)) / (n * h * sqrt(2 * np.pi))).alias("density"))
