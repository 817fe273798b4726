"""Rasters in tiles against the same cell by cell, and discs against all cells."""

import math
import random

import pytest
from heatgrid.operators import grid, tiles
from heatgrid.operators.grid import Grid
from pyspark.sql import functions as F

SIZE = 8
SOURCE = Grid(100.0, 50.0, 1.0, 1.0, 40, 30)


def raster(spark, seed, holes=0.2, nrows=40, ncols=30):
    r = random.Random(seed)
    rows = [(i, j, None if r.random() < 0.1 else r.uniform(-5, 5)) for i in range(nrows) for j in range(ncols) if r.random() > holes and not (8 <= i < 16 and 8 <= j < 16)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def found(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and len(a) > 20
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def known(df):
    return {k: v for k, v in found(df).items() if v is not None}


def test_there_and_back(spark):
    cells = raster(spark, 1)
    own = tiles.to_tiles(cells, ["value"], SIZE)
    assert own.count() == 5 * 4 - 1  # a tile without cells does not come
    same(found(tiles.to_cells(own, ["value"], SIZE)), known(cells))
    assert tiles.to_cells(tiles.to_tiles(cells.limit(0), ["value"], SIZE), ["value"], SIZE).count() == 0
    odd = spark.createDataFrame([(-1, -9, 4.0), (None, 2, 1.0), (3, 3, float("nan"))], "row int, col int, value double")
    assert found(tiles.to_cells(tiles.to_tiles(odd, ["value"], SIZE), ["value"], SIZE)) == {(-1, -9): 4.0}


def test_algebra_joins_tiles_alone(spark):
    a, b = raster(spark, 1), raster(spark, 2)
    both = tiles.aligned(tiles.to_tiles(a.withColumnRenamed("value", "x"), ["x"], SIZE), tiles.to_tiles(b.withColumnRenamed("value", "y"), ["y"], SIZE), SOURCE, SOURCE)
    got = tiles.to_cells(tiles.algebra(both, ["x", "y"], lambda v: {"value": v["x"] - v["y"]}, ["value"], SIZE), ["value"], SIZE)
    cells = grid.aligned(a, b.withColumnRenamed("value", "other"), SOURCE, SOURCE).withColumn("value", F.col("value") - F.col("other"))
    same(found(got), known(cells))
    with pytest.raises(ValueError, match="differ"):
        tiles.aligned(both, both, SOURCE, Grid(0, 0, 1, 1, 2, 2))


TARGETS = [Grid(100.3, 49.8, 0.37, 0.41, 90, 75), Grid(97.1, 52.6, 3.3, 2.9, 20, 15), Grid(100.0, 50.0, 1.0, 1.0, 40, 30), Grid(104.0, 41.5, 11.0, 7.0, 3, 2), Grid(500.0, 50.0, 1.0, 1.0, 5, 5)]


@pytest.mark.parametrize("target", TARGETS)
@pytest.mark.parametrize("how", ["bilinear", "nearest"])
def test_resampling_equals_the_cell_form(spark, target, how):
    cells = raster(spark, 3)
    every = spark.range(target.nrows).crossJoin(spark.range(target.ncols).withColumnRenamed("id", "c")).select(F.col("id").cast("int").alias("row"), F.col("c").cast("int").alias("col"))
    want = known(grid.bilinear(cells, SOURCE, target, every) if how == "bilinear" else grid.nearest(cells, SOURCE, target, every))
    got = found(tiles.to_cells(tiles.resample(tiles.to_tiles(cells, ["value"], SIZE), "value", SOURCE, target, how, SIZE), ["value"], SIZE))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert bool(want) == (target.x0 < 200)


@pytest.mark.parametrize("target", TARGETS)
def test_counts_keep_their_total(spark, target):
    cells = raster(spark, 4).withColumn("value", F.abs("value"))
    got = found(tiles.to_cells(tiles.resample_counts(tiles.to_tiles(cells, ["value"], SIZE), "value", SOURCE, target, SIZE), ["value"], SIZE))
    want = {k: v for k, v in found(grid.resample_counts(cells, SOURCE, target)).items()}
    for k in got.keys() | want.keys():  # a cell that but touches a border may come with nothing in it
        assert got.get(k, 0.0) == pytest.approx(want.get(k, 0.0), abs=1e-9)
    if target.x0 <= 100 and target.y0 >= 50 and target.x0 + target.ncols * target.dx >= 130 and target.y0 - target.nrows * target.dy <= 10:
        assert sum(got.values()) == pytest.approx(sum(known(cells).values()))


@pytest.mark.parametrize(("radius", "group"), [(0.4, 100_000), (3.3, 100_000), (7.7, 20), (25.0, 100_000)])
def test_discs_against_all_cells(spark, radius, group):
    r = random.Random(radius)
    cells = raster(spark, 5)
    points = [(i, r.uniform(95, 135), r.uniform(5, 55)) for i in range(120)] + [(200 + i, 110.123, 30.456) for i in range(50)] + [(300, None, 1.0), (301, 900.0, 900.0)]
    own = tiles.to_tiles(cells, ["value"], SIZE)
    got = {x.id: x for x in tiles.disc_sums(spark.createDataFrame(points, "id int, x double, y double"), own, "value", "id", radius, SOURCE, SIZE, group).collect()}
    assert len(got) == len(points)
    place = [(SOURCE.x0 + (j + 0.5), SOURCE.y0 - (i + 0.5), v) for (i, j), v in known(cells).items()]
    for i, x, y in points:
        values = [] if x is None else [v for a, b, v in place if (a - x) ** 2 + (b - y) ** 2 <= radius**2]
        assert got[i].n == len(values)
        assert got[i].sum == (pytest.approx(math.fsum(values), abs=1e-9) if values else None)
        assert got[i].mean == (pytest.approx(math.fsum(values) / len(values), abs=1e-9) if values else None)


def test_a_disc_takes_rows_not_cells(spark):
    """The look-ups of a point are the rows of its disc: with twice the radius twice as many, not four times."""
    asked = []
    cells = spark.range(40 * 30).select((F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.lit(1.0).alias("value"))
    own, points = tiles.to_tiles(cells, ["value"], SIZE), spark.createDataFrame([(1, 115.3, 30.2)], "id int, x double, y double")
    for radius in (4.0, 8.0):
        at = tiles.disc_sums(points, own, "value", "id", radius, SOURCE, SIZE)
        asked.append((radius, at.first().n, int(2 * radius) + 2))
    assert asked[1][1] > 3.5 * asked[0][1] and asked[1][2] < 2 * asked[0][2]
