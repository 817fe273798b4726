"""Grids as cell tables (row, col, value): alignment, resampling, clipping, profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.operators import order


@dataclass(frozen=True)
class Grid:
    """Place and size of a grid; (x0, y0) is its upper left corner, rows go down."""

    x0: float
    y0: float
    dx: float
    dy: float
    nrows: int
    ncols: int
    epsg: int = 27700

    def x(self, col: Column) -> Column:
        return self.x0 + (col + 0.5) * self.dx

    def y(self, row: Column) -> Column:
        return self.y0 - (row + 0.5) * self.dy

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.dx)

    def row(self, y: Column) -> Column:
        return F.floor((self.y0 - y) / self.dy)

    def cell_area(self) -> float:
        return abs(self.dx * self.dy)


def choose_reference(grids: DataFrame) -> DataFrame:
    """Of grid descriptors (layer, nrows, ncols) that with the most cells, the first name of equals."""
    size = F.col("nrows").cast("long") * F.col("ncols")
    return grids.withColumn("n_cells", size).orderBy(F.desc("n_cells"), "layer").limit(1)


def aligned(a: DataFrame, b: DataFrame, grid_a: Grid, grid_b: Grid, how: str = "inner") -> DataFrame:
    """Join of two layers cell by cell; their grids must be the same."""
    if grid_a != grid_b:
        raise ValueError(f"grids differ: {grid_a}, {grid_b}")
    return a.join(b, ["row", "col"], how)


def mask_nodata(value: Column, nodata: float | None = None) -> Column:
    """Not-a-numbers and the nodata value are null."""
    value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return value if nodata is None else F.nullif(value, F.lit(nodata))


def nearest(cells: DataFrame, source: Grid, target: Grid, targets: DataFrame) -> DataFrame:
    """For each target cell (row, col) the value of the source cell that its centre lies in."""
    keyed = targets.withColumns({"__r": source.row(target.y(F.col("row"))), "__c": source.col(target.x(F.col("col")))})
    own = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    return keyed.join(own, ["__r", "__c"], "left").select("row", "col", "value")


def bilinear(cells: DataFrame, source: Grid, target: Grid, targets: DataFrame) -> DataFrame:
    """For each target cell the mean of the four source cells around its centre, weighted by nearness; missing ones do not weigh."""
    fx, fy = (target.x(F.col("col")) - source.x0) / source.dx - 0.5, (source.y0 - target.y(F.col("row"))) / source.dy - 0.5
    keyed = targets.withColumns({"__fx": fx, "__fy": fy})
    wx, wy = F.col("__fx") - F.floor("__fx"), F.col("__fy") - F.floor("__fy")
    corner = lambda dr, dc: F.struct((F.floor("__fy") + dr).alias("r"), (F.floor("__fx") + dc).alias("c"), ((wy if dr else 1 - wy) * (wx if dc else 1 - wx)).alias("w"))
    keyed = keyed.select("row", "col", F.explode(F.array(*[corner(dr, dc) for dr in (0, 1) for dc in (0, 1)])).alias("n")).where("n.w > 0")
    own = cells.where("value IS NOT NULL").select(F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    hit = keyed.join(own, (F.col("n.r") == F.col("__r")) & (F.col("n.c") == F.col("__c")))
    return hit.groupBy("row", "col").agg((F.sum(F.col("value") * F.col("n.w")) / F.sum("n.w")).alias("value"))


def resample_counts(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Counts on another grid with their total kept: every source cell is dealt by area over the target cells it overlaps."""
    left, top = source.x0 + F.col("col") * source.dx, source.y0 - F.col("row") * source.dy
    right, bottom = left + source.dx, top - source.dy
    span = lambda a, b: F.sequence(a.cast("int"), b.cast("int"))
    cols = span(target.col(left), F.greatest(F.ceil((right - target.x0) / target.dx) - 1, target.col(left)))
    rows = span(target.row(top), F.greatest(F.ceil((target.y0 - bottom) / target.dy) - 1, target.row(top)))
    dealt = cells.where("value IS NOT NULL").select("value", left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"), F.explode(rows).alias("row"), cols.alias("cols")).withColumn("col", F.explode("cols"))
    wide = F.least(F.col("r"), target.x0 + (F.col("col") + 1) * target.dx) - F.greatest(F.col("l"), target.x0 + F.col("col") * target.dx)
    high = F.least(F.col("t"), target.y0 - F.col("row") * target.dy) - F.greatest(F.col("b"), target.y0 - (F.col("row") + 1) * target.dy)
    part = F.col("value") * F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0)) / source.cell_area()
    inside = F.col("row").between(0, target.nrows - 1) & F.col("col").between(0, target.ncols - 1)
    return dealt.where(inside).groupBy("row", "col").agg(F.sum(part).alias("value"))


def preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Totals before and after a resampling, and their ratio."""
    b, a = before.agg(F.sum("value").alias("before")), after.agg(F.sum("value").alias("after"))
    return b.crossJoin(a).withColumn("ratio", F.when(F.col("before") != 0, F.col("after") / F.col("before")))  # one row each


def clip(cells: DataFrame, covered: DataFrame, fill=0, crop: bool = True) -> DataFrame:
    """Values outside of the covered cells (row, col) become the fill; cells outside of their extent go with crop."""
    out = cells.join(covered.select("row", "col").distinct().withColumn("__in", F.lit(True)), ["row", "col"], "left")
    out = out.withColumn("value", F.when(F.col("__in"), F.col("value")).otherwise(F.lit(fill))).drop("__in")
    if not crop:
        return out
    box = covered.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))  # one row
    return out.join(F.broadcast(box), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")


def zoom_window(cells: DataFrame, grid: Grid, x: float, y: float, size_m: float) -> DataFrame:
    """Cells of the square of size_m around a place."""
    half = size_m / 2
    return cells.where(grid.x(F.col("col")).between(x - half, x + half) & grid.y(F.col("row")).between(y - half, y + half))


def lattice(points: DataFrame, x0: float, y0: float, size: float = 10.0) -> DataFrame:
    """Add the tile (i, j) of each point on a lattice."""
    return points.withColumns({"i": F.floor((F.col("x") - x0) / size), "j": F.floor((F.col("y") - y0) / size)})


def majority(points: DataFrame, value: str) -> DataFrame:
    """Per tile the number of points and the most frequent value, the smallest of equals; nulls do not vote."""
    votes = points.groupBy("i", "j", value).agg(F.count("*").alias("n"))
    best = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(F.col("n"), -F.col(value))))
    return votes.groupBy("i", "j").agg(F.sum("n").alias("points"), best.alias(value))


def with_corners(tiles: DataFrame, x0: float, y0: float, size: float = 10.0) -> DataFrame:
    x, y = x0 + F.col("i") * size, y0 + F.col("j") * size
    return tiles.withColumns({"xmin": x, "ymin": y, "xmax": x + size, "ymax": y + size})


def layer_extremes(cells: DataFrame, layer: str = "layer", value: str = "value") -> DataFrame:
    return cells.groupBy(layer).agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("largest"))


def scene_mean(cells: DataFrame) -> DataFrame:
    """Mean over the scenes of a tile, cell by cell (tile, row, col, value)."""
    return cells.groupBy("tile", "row", "col").agg(F.avg("value").alias("value"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """Tiles on one grid (tile, row, col, value): where they overlap the last tile shows."""
    return tiles.where("value IS NOT NULL").groupBy("row", "col").agg(F.max_by("value", "tile").alias("value"))


def profile(cells: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes, percentiles and number of positive values."""
    x = F.col(value)
    shares = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
    own = cells.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("largest"), F.count_if(x > 0).alias("n_positive"))
    return own.crossJoin(order.quantiles(cells, value, shares))  # one row each


def colour_limits(cells: DataFrame, value: str, pad: float = 0.0) -> DataFrame:
    """Limits of a colour scale: symmetric about 0 where the values have both signs, else from 0."""
    out = cells.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    far = F.greatest(F.abs("lo"), F.abs("hi")) * (1 + pad)
    both = (F.col("lo") < 0) & (F.col("hi") > 0)
    return out.select(F.when(both | (F.col("hi") <= 0), -far).otherwise(0.0).alias("low"), F.when(both | (F.col("lo") >= 0), far).otherwise(0.0).alias("high"))
