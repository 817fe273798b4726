"""Heat-attributable deaths over cell tables.

Cells are (row, col) rows with t0, t1, pop0, pop1 and deaths columns per cause (long: cause, deaths). Causes are a small
dimension of fixed size that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.functions import health as H


def causes(spark: SparkSession, rows=H.CAUSES) -> DataFrame:
    """The causes with slope and standard error."""
    frame = spark.createDataFrame(rows, "cause string, rr double, rr_low double, rr_high double")
    return frame.select("*", H.beta_from_rr(F.col("rr")).alias("beta"), H.se_from_ci(F.col("rr_low"), F.col("rr_high")).alias("se"))


def delta_t(cells: DataFrame, limit: float | None = None) -> DataFrame:
    """Add delta = t1 - t0; beyond the limit (either way) it is null."""
    delta = F.col("t1") - F.col("t0")
    return cells.withColumn("delta", delta if limit is None else F.when(F.abs(delta) <= limit, delta))


def with_excess(cells: DataFrame, causes: DataFrame) -> DataFrame:
    """A row per cell and cause with adjusted deaths, attributable fraction and excess deaths."""
    out = delta_t(cells).crossJoin(F.broadcast(causes.select("cause", "beta")))
    out = out.withColumn("adjusted", H.adjusted_deaths(F.col("deaths"), F.col("pop0"), F.col("pop1")))
    out = out.withColumn("af", H.attributable_fraction(F.col("beta"), F.col("delta")))
    return out.withColumn("excess", H.excess_deaths(F.col("adjusted"), F.col("af")))


def city_totals(with_excess: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Deaths and excess per cause; adjusted deaths count where the temperature is missing too, missing sums are 0."""
    total = with_excess.groupBy(*(by or ["cause"])).agg(F.coalesce(F.sum("adjusted"), F.lit(0.0)).alias("deaths"), F.coalesce(F.sum("excess"), F.lit(0.0)).alias("excess"))
    both = F.col("deaths") + F.col("excess")
    return total.withColumn("share", F.when(both > 0, F.col("excess") / both).otherwise(0.0))


def normal_draws(causes: DataFrame, quantiles: list[float]) -> DataFrame:
    """(cause, draw, beta): slopes at fixed standard-normal quantiles; draw counts from 1."""
    z = F.array(*map(F.lit, quantiles))
    return causes.select("cause", F.posexplode(z).alias("draw", "z"), "beta", "se").select("cause", (F.col("draw") + 1).alias("draw"), (F.col("beta") + F.col("z") * F.col("se")).alias("beta"))


def random_draws(causes: DataFrame, n: int, seed: int = 2025) -> DataFrame:
    """(cause, draw, beta): slopes drawn at random, n for each cause."""
    return causes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("cause", "draw", (F.col("beta") + F.col("se") * F.randn(seed)).alias("beta"))


def draw_totals(cells: DataFrame, draws: DataFrame) -> DataFrame:
    """City excess per cause and draw of draws (cause, draw, beta), a small dimension; cells without a change or adjusted deaths add none.

    A task sums its cells' deaths by temperature change, batch by batch, and multiplies changes and draws as matrices; it
    hands on one row a cause, with the sums of all draws. No cells give no rows.
    """
    betas: dict[str, list[tuple[int, float]]] = {}
    for r in draws.select("cause", "draw", "beta").collect():  # causes x draws
        betas.setdefault(r["cause"], []).append((r["draw"], r["beta"]))
    slopes = {cause: np.array([b for _, b in own], float) for cause, own in betas.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = {cause: np.zeros(len(beta)) for cause, beta in slopes.items()}, False
        for batch in batches:
            seen |= len(batch) > 0
            delta, adjusted = (np.array(c.to_numpy(zero_copy_only=False), float) for c in batch.columns)
            known = ~(np.isnan(delta) | np.isnan(adjusted))
            changes, of = np.unique(delta[known], return_inverse=True)
            deaths = np.bincount(of, adjusted[known], len(changes))
            for at in range(0, len(changes), 2000):
                for cause, beta in slopes.items():
                    with np.errstate(over="ignore", invalid="ignore"):
                        af = -np.expm1(-np.outer(changes[at : at + 2000], beta))
                    af[~np.isfinite(af)] = 0.0
                    total[cause] += deaths[at : at + 2000] @ af
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["cause", "sums"])

    own = delta_t(cells).select(F.col("delta").cast("double"), H.adjusted_deaths(F.col("deaths"), F.col("pop0"), F.col("pop1")).cast("double").alias("adjusted"))
    parts = own.mapInArrow(sums, "cause string, sums array<double>").groupBy("cause").agg(F.collect_list("sums").alias("parts"))  # a row a task
    whole = F.aggregate("parts", F.array_repeat(F.lit(0.0), F.size(F.get("parts", F.lit(0)))), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    numbers = cells.sparkSession.createDataFrame([(cause, [n for n, _ in own]) for cause, own in betas.items()], "cause string, numbers array<int>")
    out = parts.select("cause", whole.alias("excess")).join(F.broadcast(numbers), "cause")
    return out.select("cause", F.explode(F.arrays_zip(F.col("numbers").alias("draw"), "excess")).alias("d")).select("cause", "d.draw", "d.excess")


def draw_summary(totals: DataFrame) -> DataFrame:
    """p2.5, median, p97.5, mean, population deviation, least and largest of the draws of each cause."""
    x = F.col("excess")
    return totals.groupBy("cause").agg(
        F.percentile(x, 0.025).alias("p2_5"), F.percentile(x, 0.5).alias("p50"), F.percentile(x, 0.975).alias("p97_5"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("largest")
    )


def draw_matrix(totals: DataFrame, names: list[str]) -> DataFrame:
    """A row per draw, a column per cause."""
    return totals.groupBy("draw").pivot("cause", names).agg(F.first("excess"))
