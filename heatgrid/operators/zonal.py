"""Zonal statistics (A9-A14): a table of a zone's cells is made once, then joined and aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.operators import geometry
from heatgrid.operators.grid import Grid


def zonal(cells: DataFrame, zone_cells: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and sum of a value over the cells of each zone; nulls do not count."""
    return cells.join(zone_cells, ["row", "col"]).groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("sum"))


def coverage(zones: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(row, col, key, coverage): exact share of each cell's area in a zone."""
    return geometry.cells_covered(zones, key, grid)


def weighted_mean(cells: DataFrame, covered: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of a value weighted by the cells' coverage."""
    own = cells.where(F.col(value).isNotNull()).join(covered, ["row", "col"])
    return own.groupBy(key).agg((F.sum(F.col(value) * F.col("coverage")) / F.sum("coverage")).alias("mean"), F.sum("coverage").alias("cells"))


def tree_cover(zone_cells: DataFrame, trees: DataFrame, areas: DataFrame, key: str, cell_m2: float) -> DataFrame:
    """Percent of a zone's polygon area (key, area) that its tree cells (row, col) are."""
    hit = zone_cells.join(trees.select("row", "col").distinct().withColumn("tree", F.lit(True)), ["row", "col"], "left")
    n = hit.groupBy(key).agg(F.count_if(F.coalesce("tree", F.lit(False))).alias("tree_cells"))
    return areas.join(n, key, "left").select(key, F.coalesce("tree_cells", F.lit(0)).alias("tree_cells"), (F.coalesce("tree_cells", F.lit(0)) * cell_m2 / F.col("area") * 100).alias("tree_pct"))


def by_centroid(zones: DataFrame, buildings: DataFrame, key: str, building_key: str, value: str, size: float = 10.0) -> DataFrame:
    """Number, sum and mean of a value over the buildings (x, y: centroid) of each zone; zones without any have 0."""
    hit = geometry.points_in_polygons(buildings, zones, building_key, key, False, size).join(buildings.select(building_key, value), building_key)
    found = hit.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    return zones.select(key).join(found, key, "left").na.fill(0, ["n"]).na.fill(0.0, ["sum", "mean"])


def known(value: Column) -> Column:
    """A text; null where it is blank."""
    return F.nullif(F.trim(value), F.lit(""))


def mode_smallest(value: Column) -> Column:
    """Most frequent known value, the smallest of equals."""
    return F.mode(known(value), True)


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per group the most frequent known value, of equals the one that comes first in the order."""
    n = df.where(known(F.col(value)).isNotNull()).groupBy(*keys, known(F.col(value)).alias("v")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by("v", F.struct(F.col("n"), -F.col("first"))).alias(value))


def uniques_sorted(value: Column) -> Column:
    return F.array_sort(F.collect_set(known(value)))


def point_attributes(matched: DataFrame, key: str, point_key: str, attributes: list[str]) -> DataFrame:
    """Per polygon the number of points matched, and mode and sorted different values of attributes."""
    own = [c for a in attributes for c in (mode_smallest(F.col(a)).alias(f"{a}_mode"), F.to_json(uniques_sorted(F.col(a))).alias(f"{a}_unique"))]
    return matched.groupBy(key).agg(F.count(point_key).alias("point_count"), *own)


def green_view_index(pixels: DataFrame, key: str, classes: list[int], headings: int = 6) -> DataFrame:
    """Share of green pixels of each image (key, heading, class_id, n_px), summed over a place's images, by the number of headings."""
    green = F.sum(F.when(F.col("class_id").isin(classes), F.col("n_px")))
    return pixels.groupBy(key, "heading").agg((green / F.sum("n_px")).alias("share")).groupBy(key).agg((F.sum("share") / headings).alias("gvi"))
