"""Land-cover scenarios and their accounts over cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.functions.classify import LAND_COVER
from heatgrid.operators import order

#: The built classes that trees may stand in, and the classes a paving scenario takes.
TREE_CANOPY, PAVED = 100, 20
TO_PAVED = [1, 2, 4, 5, 6, 7, 9, 10, 100]
CANOPY_TARGETS = [5, 6]
RISK_CLASSES, RISK_TO = [1, 2, 100], 4


def classes(spark: SparkSession, table: dict[int, str] = LAND_COVER) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "code int, label string")


def valid(code: Column) -> Column:
    """0 is no data."""
    return code.isNotNull() & (code != 0)


def burn_in(code: Column, covered: Column, to: int = TREE_CANOPY) -> Column:
    """Covered cells with data become the new class."""
    return F.when(F.coalesce(covered, F.lit(False)) & valid(code), to).otherwise(code)


def pave(code: Column, sources: list[int] = TO_PAVED, to: int = PAVED) -> Column:
    return F.when(code.isin(sources), to).otherwise(code)


def tree_risk(code: Column, year: Column, at: int = 2050) -> Column:
    """Woodland and canopy whose trees are at risk in the year become grassland."""
    return F.when(code.isin(RISK_CLASSES) & F.coalesce(year == at, F.lit(False)), RISK_TO).otherwise(code)


def canopy_reclass(code: Column, canopy_pct: Column) -> Column:
    """Target classes times ten, plus 1 up to 7 % of canopy, 2 up to 20 %, 3 above, 0 in all where it is unknown; others times ten."""
    split = F.when(canopy_pct <= 7, code * 10 + 1).when(canopy_pct <= 20, code * 10 + 2).when(canopy_pct > 20, code * 10 + 3).otherwise(0)
    return F.when(code.isin(CANOPY_TARGETS), split).otherwise(code * 10)


def class_summary(cells: DataFrame, code: str, labels: DataFrame, cell_m2: float = 100.0) -> DataFrame:
    """Cells, share and area of the classes that are there."""
    n = cells.where(valid(F.col(code))).groupBy(F.col(code).alias("code")).agg(F.count("*").alias("cells"))
    n = n.join(F.broadcast(labels), "code", "left").withColumn("share", F.col("cells") / F.sum("cells").over(Window.partitionBy()))  # a row a class
    m2 = F.col("cells") * cell_m2
    return n.select(
        "code", F.coalesce("label", F.concat(F.lit("Unknown ("), F.col("code"), F.lit(")"))).alias("label"), "cells", F.round("share", 6).alias("share"), F.round(F.col("share") * 100, 3).alias("pct"),
        m2.alias("m2"), F.round(m2 / 1e4, 2).alias("ha"), F.round(m2 / 1e6, 2).alias("km2"),
    )


def class_areas(cells: DataFrame, code: str, labels: DataFrame, cell_m2: float = 100.0) -> DataFrame:
    """Area of all known classes, also those without cells, and of unknown ones; percent of cells with data."""
    n = cells.where(valid(F.col(code))).groupBy(F.col(code).alias("found")).agg(F.count("*").alias("n"))
    out = labels.join(n, F.col("code") == F.col("found"), "full").select(F.coalesce("code", "found").alias("code"), F.coalesce("label", F.lit("Unknown")).alias("label"), F.coalesce("n", F.lit(0)).alias("cells"))
    total = F.sum("cells").over(Window.partitionBy())  # a row a class
    return out.withColumns({"km2": F.round(F.col("cells") * cell_m2 / 1e6, 4), "pct": F.when(total > 0, F.round(F.col("cells") * 100 / total, 4)).otherwise(0.0)})


def with_total(areas: DataFrame) -> DataFrame:
    """Class areas and a row of their totals."""
    total = areas.agg(F.lit(None).cast("int").alias("code"), F.lit("Total").alias("label"), F.sum("cells").alias("cells"), F.round(F.sum("km2"), 4).alias("km2"), F.round(F.sum("pct"), 1).alias("pct"))
    return areas.unionByName(total)


def area_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells and area of each class before and after (class_summary of both); missing ones are 0."""
    b, a = (x.select("code", F.col("cells").alias(f"cells_{s}"), F.col("ha").alias(f"ha_{s}")) for x, s in ((before, "before"), (after, "after")))
    both = b.join(a, "code", "full").na.fill(0)
    return both.withColumns({"cells_change": F.col("cells_after") - F.col("cells_before"), "ha_change": F.round(F.col("ha_after") - F.col("ha_before"), 2)})


def transitions(cells: DataFrame, before: str, after: str, labels: DataFrame, cell_m2: float = 100.0, include_nodata: bool = True) -> DataFrame:
    """Transition matrix in long form, stable classes last; no data is a class of its own unless left out."""
    if not include_nodata:
        cells = cells.where(valid(F.col(before)) & valid(F.col(after)))
    n = cells.groupBy(F.col(before).alias("from_code"), F.col(after).alias("to_code")).agg(F.count("*").alias("cells"))
    for side in ("from", "to"):
        names = labels.select(F.col("code").alias(f"{side}_code"), F.col("label").alias(f"{side}_known"))
        n = n.join(F.broadcast(names), f"{side}_code", "left")
        n = n.withColumn(f"{side}_label", F.coalesce(f"{side}_known", F.concat(F.lit("Unknown ("), F.col(f"{side}_code"), F.lit(")")))).drop(f"{side}_known")
    status = F.when(F.col("from_code") == F.col("to_code"), "Stable").otherwise("Change")
    n = n.withColumns({"code": F.col("from_code") * 1000 + F.col("to_code"), "status": status, "m2": F.col("cells") * cell_m2, "km2": F.col("cells") * cell_m2 / 1e6})
    return n.orderBy("status", F.desc("m2"), "code")


def changed_cells(cells: DataFrame, before: str, after: str, cell_m2: float = 100.0) -> DataFrame:
    n = F.count_if(F.col(before) != F.col(after))
    return cells.agg(n.alias("cells"), (n * cell_m2).alias("m2"))


def top_ranked(points: DataFrame, scenarios: DataFrame, rank: str = "rank", key: str = "id") -> DataFrame:
    """For each scenario (scenario, n_trees) its n_trees points of the smallest rank, ties by key, in one pass over ranges of ranks."""
    return order.with_places(points, [rank, key]).join(F.broadcast(scenarios), F.col("place") <= F.col("n_trees"))
