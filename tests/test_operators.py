"""Operators on small hand-worked tables: ties, nulls, borders, and properties that must hold."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from heatgrid.functions import classify, climate, dates, health, text
from heatgrid.operators import geometry, grid, landcover, observations, order, profile, scenario, stats, trees, vulnerability, zonal
from heatgrid.operators import health as deaths
from heatgrid.operators.grid import Grid
from heatgrid.plans import queries
from heatgrid.sources import readers, sinks

G = Grid(0.0, 10.0, 1.0, 1.0, 10, 10)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def ring(*points):
    return [[(float(x), float(y)) for x, y in points]]


def shapes(spark, rows):
    return spark.createDataFrame(rows, "id string, rings array<array<struct<x:double,y:double>>>")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- health


def test_attributable_deaths(spark):
    cells = spark.createDataFrame([(0, 0, 20.0, 21.0, 10.0, 20.0, 2.0), (0, 1, 20.0, None, 10.0, 10.0, 1.0), (0, 2, 20.0, 19.0, 0.0, 5.0, 1.0), (0, 3, 20.0, 20.0, 5.0, None, 1.0)], "row int, col int, t0 double, t1 double, pop0 double, pop1 double, deaths double")
    total = {r.cause: r for r in deaths.city_totals(deaths.with_excess(cells, deaths.causes(spark))).collect()}
    r = total["cardiovascular"]
    assert r.deaths == pytest.approx(4 + 1) and r.excess == pytest.approx(4 * 0.0344 / 1.0344)  # a cell without change still counts its deaths
    assert r.share == pytest.approx(r.excess / (r.deaths + r.excess))
    none = deaths.city_totals(deaths.with_excess(cells.where("pop0 = 0"), deaths.causes(spark))).first()
    assert (none.deaths, none.excess, none.share) == (0, 0, 0)


def test_draws(spark):
    causes = deaths.causes(spark)
    cells = spark.createDataFrame([(1.0, 2.0, 1.0, 1.0, 3.0), (1.0, 2.0, 1.0, 1.0, 4.0), (1.0, 0.0, 1.0, 2.0, 5.0)], "t0 double, t1 double, pop0 double, pop1 double, deaths double")
    totals = deaths.draw_totals(cells, deaths.normal_draws(causes, [0.0, 1.0]))
    got = {(r.cause, r.draw): r.excess for r in totals.collect()}
    assert got["all_cause", 1] == pytest.approx(7 * (1 - 1 / 1.02) + 10 * (1 - 1.02))
    assert deaths.random_draws(causes, 4).count() == 20
    row = {r.cause: r for r in deaths.draw_summary(totals).collect()}["all_cause"]
    assert row.sd == pytest.approx(abs(got["all_cause", 1] - got["all_cause", 2]) / 2)
    assert deaths.draw_matrix(totals, ["all_cause", "self_harm"]).columns == ["draw", "all_cause", "self_harm"]


def test_formulas(spark):
    r = one(spark, e=climate.magnus_kpa(F.lit(20.0)), w=climate.workability(F.lit(30.94)), cold=climate.workability(F.lit(0.0)), se=health.se_from_ci(F.lit(1.0), F.lit(math.e)), c=health.deaths_per_cell(F.lit(10.0), F.lit(1.0), 10.0), none=health.adjusted_deaths(F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    assert r.e == pytest.approx(2.338, abs=2e-3) and r.w == pytest.approx(0.55) and r.cold == 1 and r.se == pytest.approx(1 / 3.92) and r.c == pytest.approx(0.1) and r.none is None


# ---- recodes, names and dates


def test_recodes(spark):
    r = one(
        spark, a=classify.scenario(F.lit("s0_s2")), b=classify.scenario(F.lit("s3")), c=classify.scenario(F.lit("s99")), d=classify.climate_year(F.lit("x_22_5")), e=classify.climate_year(F.lit("scenario520")),
        f=classify.park_class_by_area(F.lit(400.0)), g=classify.park_class_by_area(F.lit(0.4)), h=classify.park_class_by_area(F.lit(None).cast("double")), i=classify.tree_condition(F.lit("DEAD"), F.lit(None).cast("string")),
        j=classify.tree_condition(F.lit(None).cast("string"), F.lit("PK")), k=classify.tree_condition(F.lit("young"), F.lit(None).cast("string")), l=classify.centimetres(F.lit(0.125)), m=classify.centimetres(F.lit(float("inf"))),
    )
    assert list(r) == ["scenario3_TO", "scenario2_TR", None, "2030", None, "2 Metropolitan Parks", "6 Pocket Parks", "Unclassified", "dying", None, "not dying", 12, None]


def test_names_and_dates(spark):
    path = F.lit("/base/current_lulc/x/T_air_london_scenario_20.0deg_2.0uhi_66.9hum.tif")
    when = F.lit("2021-12-31 19:59:00").cast("timestamp")
    r = one(
        spark, a=text.short_name(path, "/base"), b=text.short_name(F.lit("/other/x"), "/base"), c=text.safe_name(F.lit("_A  (b)-c.d_")), d=text.clean_number(F.lit(" 1,234.5")), e=text.clean_number(F.lit("")),
        f=dates.week_of_year(when), g=dates.day_or_night(when), h=dates.quarter_season(when), i=dates.meteorological_season(when), j=dates.year_season(when), k=dates.first_of_month(when), l=text.stars(F.lit(0.009)), m=dates.from_epoch_millis(F.lit(86_400_000)),
    )
    assert list(r) == ["current_lulc_20_2", None, "a_b_c.d", 1234.5, None, 53, "day", "fall", "Winter", "2021_Winter", dt.date(2021, 12, 1), "**", dt.date(1970, 1, 2)]
    a, b = text.split_parts(F.lit("x.y:z:w"), ":", 2)
    assert list(one(spark, a=a, b=b)) == ["x.y", "z:w"]


# ---- land cover


def test_land_cover_scenarios(spark):
    df = spark.createDataFrame([(0, 5.0), (5, 7.0), (5, 20.0), (6, 20.1), (5, None), (3, 1.0), (1, None), (100, None)], "lc int, pct double")
    got = [tuple(r) for r in df.select(landcover.canopy_reclass(F.col("lc"), F.col("pct")), landcover.pave(F.col("lc")), landcover.burn_in(F.col("lc"), F.lit(True)), landcover.tree_risk(F.col("lc"), F.lit(2050))).collect()]
    assert got == [(0, 0, 0, 0), (51, 20, 100, 5), (52, 20, 100, 5), (63, 20, 100, 6), (0, 20, 100, 5), (30, 3, 100, 3), (10, 20, 100, 4), (1000, 20, 100, 4)]


def test_transition_margins_are_class_areas(spark):
    cells = spark.range(1000).select((F.col("id") % 7).cast("int").alias("a"), (F.col("id") % 5).cast("int").alias("b"))
    labels = landcover.classes(spark)
    t = landcover.transitions(cells, "a", "b", labels, include_nodata=False)
    margin = {r[0]: r[1] for r in t.groupBy("from_code").sum("cells").collect()}
    areas = landcover.class_areas(cells.where("b <> 0"), "a", labels)
    assert {r.code: r.cells for r in areas.collect() if r.cells} == margin and areas.count() == 22
    assert landcover.transitions(cells, "a", "b", labels).agg(F.sum("cells")).first()[0] == 1000
    assert landcover.with_total(areas).where("label = 'Total'").first().cells == sum(margin.values())


def test_top_ranked_takes_ties_by_key(spark):
    points = spark.createDataFrame([(i, i // 3 * 7000) for i in range(30)], "id long, rank long")
    names = spark.createDataFrame([("a", 4), ("b", 20), ("c", 99)], "scenario string, n_trees int")
    got = landcover.top_ranked(points, names)
    for name, n in (("a", 4), ("b", 20), ("c", 30)):
        assert sorted(r.id for r in got.where(F.col("scenario") == name).collect()) == list(range(n))


# ---- grids


def test_resampling(spark):
    cells = spark.range(100).select(F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), (F.col("id") % 9).cast("double").alias("value"))
    coarse, odd = Grid(0.0, 10.0, 2.0, 2.0, 5, 5), Grid(-0.3, 10.2, 1.7, 1.7, 7, 7)
    for other in (coarse, odd):
        p = grid.preservation(cells, grid.resample_counts(cells, G, other)).first()
        assert p.ratio == pytest.approx(1.0)
    targets = grid.resample_counts(cells, G, coarse).select("row", "col")
    got = {(r.row, r.col): r.value for r in grid.bilinear(cells, G, coarse, targets).collect()}
    assert got[0, 0] == pytest.approx((0 + 1 + 1 + 2) / 4)  # the mean of the cells around the corner
    assert {(r.row, r.col): r.value for r in grid.nearest(cells, coarse, G, cells.select("row", "col").limit(0)).collect()} == {}
    with pytest.raises(ValueError, match="grids differ"):
        grid.aligned(cells, cells, G, coarse)


def test_lattice_majority_ignores_nulls(spark):
    points = spark.createDataFrame([(1.0, 1.0, 2050), (2.0, 2.0, 2070), (3.0, 3.0, 2070), (4.0, 4.0, 2050), (5.0, 5.0, None), (5.0, 5.5, None), (5.0, 6.0, None), (15.0, 0.0, None)], "x double, y double, year int")
    assert pairs(grid.majority(grid.lattice(points, 0.0, 0.0), "year").na.fill(-1), "i", "j", "points", "year") == [(0, 0, 7, 2050), (1, 0, 1, -1)]


def test_clip_and_limits(spark):
    cells = spark.createDataFrame([(r, c, 5.0) for r in range(4) for c in range(4)], "row int, col int, value double")
    covered = spark.createDataFrame([(1, 1), (2, 2)], "row int, col int")
    assert sorted(r.value for r in grid.clip(cells, covered).collect()) == [0, 0, 5, 5]
    assert grid.clip(cells, covered, crop=False).count() == 16
    lim = lambda *v: tuple(grid.colour_limits(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first())
    assert lim(-2, 1) == (-2, 2) and lim(1, 3) == (0, 3) and lim(-3, -1) == (-3, 0)


# ---- geometry

CONCAVE = ("c", ring((0, 0), (6, 0), (6, 6), (3, 2), (0, 6)))
HOLED = ("h", ring((0, 0), (9, 0), (9, 9), (0, 9)) + ring((3, 3), (6, 3), (6, 6), (3, 6)))


def inside(x, y, rings):
    n = 0
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def test_points_in_polygons(spark):
    polygons = shapes(spark, [CONCAVE, HOLED])
    places = [(i, (i * 37 % 100) / 10 + 0.01, (i * 53 % 100) / 10 + 0.013) for i in range(200)]
    points = spark.createDataFrame(places, "p int, x double, y double")
    want = sorted((p, k) for p, x, y in places for k, r in (CONCAVE, HOLED) if inside(x, y, r))
    for most in (1, 4, 100):
        assert pairs(geometry.points_in_polygons(points, polygons, "p", "id", most_edges=most), "p", "id") == want
    border = spark.createDataFrame([(1, 3.0, 0.0), (2, 6.0, 6.0), (3, 20.0, 0.0), (4, None, 1.0)], "p int, x double, y double")
    assert pairs(geometry.points_in_polygons(border, shapes(spark, [CONCAVE]), "p", "id"), "p") == []
    assert pairs(geometry.polygons_with_points(shapes(spark, [CONCAVE, ("far", ring((90, 90), (91, 90), (91, 91)))]), border, "id", "p").na.fill(0), "id", "p") == [("c", 1), ("c", 2), ("far", 0)]


def test_nearest_keeps_ties_within_the_limit(spark):
    square = shapes(spark, [("s", ring((0, 0), (10, 0), (10, 10), (0, 10)))])
    points = spark.createDataFrame([(1, 14.0, 5.0), (2, -4.0, 5.0), (3, 16.0, 5.0)], "p int, x double, y double")
    assert pairs(geometry.nearest_within(points, square, "p", "id", 5.0), "p", "distance") == [(1, 4.0), (2, 4.0)]
    assert geometry.nearest_within(points.where("p = 3"), square, "p", "id", 5.0).count() == 0
    inner = points.union(spark.createDataFrame([(4, 5.0, 5.0)], "p int, x double, y double"))
    assert pairs(geometry.nearest_within(inner, square, "p", "id", 5.0), "p", "distance") == [(4, 0.0)]


def test_cells_of_polygons(spark):
    polygons = shapes(spark, [CONCAVE, HOLED])
    got = set(pairs(geometry.cells_by_centre(polygons, "id", G), "row", "col", "id"))
    assert got == {(r, c, k) for r in range(10) for c in range(10) for k, rings in (CONCAVE, HOLED) if inside(c + 0.5, 10 - r - 0.5, rings)}
    touched = set(pairs(geometry.cells_touched(polygons, "id", G), "row", "col", "id"))
    assert got < touched
    sliver = shapes(spark, [("s", ring((0.1, 0.1), (8.9, 0.1), (8.9, 0.2)))])
    assert geometry.cells_by_centre(sliver, "id", G).count() == 0 and geometry.cells_touched(sliver, "id", G).count() == 9
    circle = spark.createDataFrame([(5.0, 5.0)], "x double, y double")
    assert set(pairs(geometry.cells_in_circles(circle, 2.0, G), "row", "col")) == {(r, c) for r in range(10) for c in range(10) if (c + 0.5 - 5) ** 2 + (10 - r - 0.5 - 5) ** 2 <= 4}


def test_touched_cells_come_once_and_are_told_apart_in_runs(spark):
    """Stars that leave the grid on all sides, with many edges in a cell and cells of several runs; no aggregate over cells."""
    r = random.Random(8)
    stars = []
    for k in range(12):
        cx, cy, n = r.uniform(-1, 11), r.uniform(-1, 11), r.choice([3, 7, 40])
        stars.append((k, [[(cx + d * math.cos(6.283 * i / n), cy + d * math.sin(6.283 * i / n)) for i, d in enumerate(r.uniform(0.2, 6) for _ in range(n))]]))
    polygons = spark.createDataFrame([(k, rings) for k, rings in stars], "id int, rings array<array<struct<x:double,y:double>>>")
    own = geometry.cells_touched(polygons, "id", G)
    assert "Aggregate" not in own._jdf.queryExecution().executedPlan().toString()
    got = pairs(own, "row", "col", "id")
    want = {(row, c, k) for k, rings in stars for row in range(10) for c in range(10) if inside(c + 0.5, 10 - row - 0.5, rings)}
    for k, (points,) in stars:
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
            # the cells between the places where an edge crosses lines of the grid
            cuts = [0.0, 1.0] + [(v - a) / (b - a) for a, b in ((x1, x2), (y1, y2)) for v in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1)]
            for t, u in zip(sorted(cuts), sorted(cuts)[1:], strict=False):
                col, row = math.floor(x1 + (t + u) / 2 * (x2 - x1)), math.floor(10 - y1 - (t + u) / 2 * (y2 - y1))
                if u - t > 1e-12 and 0 <= row < 10 and 0 <= col < 10:
                    want.add((row, col, k))
    assert len(got) == len(set(got)) and set(got) == want
    centre = pairs(geometry.cells_by_centre(polygons, "id", G), "row", "col", "id")
    assert len(centre) == len(set(centre)) and set(centre) < want
    polygons = polygons.withColumn("v", F.col("id") * 1.5)
    means = {(x.row, x.col): x.v for x in geometry.rasterise_mean(polygons, "id", G, ["v"]).collect()}
    at = {}
    for row, c, k in want:
        at.setdefault((row, c), []).append(k * 1.5)
    assert means.keys() == at.keys() and all(means[c] == pytest.approx(sum(v) / len(v)) for c, v in at.items())


def test_areas_overlay_and_coverage(spark):
    zone = shapes(spark, [("z", ring((0, 0), (5, 0), (5, 5), (0, 5)))])
    squares = shapes(spark, [("in", ring((1, 1), (2, 1), (2, 2), (1, 2))), ("half", ring((4, 4), (6, 4), (6, 5), (4, 5))), ("out", ring((7, 7), (8, 7), (8, 8), (7, 8)))]).withColumnRenamed("id", "f")
    assert pairs(geometry.overlay_area(squares, zone, "f", "id", 2.0), "f", "m2") == [("half", 1.0), ("in", 1.0)]
    assert geometry.total_area(shapes(spark, [HOLED]), "id").first().m2 == 72
    assert geometry.drop_small_parts(squares, "f", 1.5).count() == 1
    cx, cy = geometry.ring_centroid(F.get("rings", F.lit(0)))
    assert tuple(zone.select(cx, cy).first()) == (2.5, 2.5)
    part = shapes(spark, [("p", ring((0, 0), (2.5, 0), (2.5, 1), (0, 1)))])
    assert {(r.row, r.col): r.coverage for r in zonal.coverage(part, "id", G).collect()} == {(9, 0): 1.0, (9, 1): 1.0, (9, 2): 0.5}
    cells = spark.createDataFrame([(9, 0, 0.0), (9, 1, 100.0)], "row int, col int, v double")
    thin = shapes(spark, [("t", ring((0, 0), (1.1, 0), (1.1, 1), (0, 1)))])
    assert zonal.weighted_mean(cells, zonal.coverage(thin, "id", G), "id", "v").first()["mean"] == pytest.approx(100 * 0.1 / 1.1)


def shared_area(a, b, n=400):
    """By strips: in each the crossings of both outlines are paired (even-odd), the overlap of the pairs is exact at its middle."""
    def spans(rings, x):
        ys = []
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
                if (x1 > x) != (x2 > x):
                    ys.append(y1 + (x - x1) / (x2 - x1) * (y2 - y1))
        ys.sort()
        return list(zip(ys[::2], ys[1::2], strict=True))

    xs = [x for r in a for x, _ in r]
    low, step = min(xs), (max(xs) - min(xs)) / n
    return sum(max(0.0, min(q, s) - max(p, r)) for i in range(n) for p, q in spans(a, low + (i + 0.5) * step) for r, s in spans(b, low + (i + 0.5) * step)) * step


ODD_SHAPES = {
    "concave": [[(0, 0), (4, 0), (4, 3), (3, 3), (3, 1), (1, 1), (1, 3), (0, 3)]],
    "clockwise": [[(1, 1), (1, 5), (5, 5), (5, 1)]],
    "holed": [[(0.5, 0.5), (8.5, 0.7), (8.2, 8.9), (0.3, 8.1)], [(2, 2), (6, 2.5), (5, 6), (2.2, 5.5)]],
    "hole turned": [[(0.5, 0.5), (0.3, 8.1), (8.2, 8.9), (8.5, 0.7)], [(2, 2), (6, 2.5), (5, 6), (2.2, 5.5)]],
    "star": [[(5, 9.3), (4, 6), (0.7, 6), (3.3, 4), (2.2, 0.6), (5, 2.7), (7.8, 0.6), (6.7, 4), (9.3, 6), (6, 6)]],
    "far": [[(20, 20), (21, 20), (21, 21)]],
    "two parts": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(6, 6), (6, 8), (8, 8), (8, 6)]],
    "island first": [[(3, 3), (4, 3), (4, 4), (3, 4)], [(2, 2), (2, 6), (6, 6), (6, 2)], [(0, 0), (8, 0), (8, 8), (0, 8)], [(9, 9), (9.6, 9), (9.6, 9.6)]],
    "touching": [[(1, 1), (5, 1), (5, 5), (1, 5)], [(5, 5), (9, 5), (9, 9), (5, 9)], [(1, 1), (3, 2), (2, 3)]],
}


def test_overlay_and_coverage_of_odd_shapes(spark):
    frame = shapes(spark, [(k, [ring(*r)[0] for r in rings]) for k, rings in ODD_SHAPES.items()])
    both = {(r.id, r.f): r.m2 for r in geometry.overlay_area(frame, frame.withColumnRenamed("id", "f"), "id", "f", 2.0).collect()}
    for a, ra in ODD_SHAPES.items():
        for b, rb in ODD_SHAPES.items():
            assert both.get((a, b), 0.0) == pytest.approx(shared_area(ra, rb), abs=0.05), (a, b)
    area = {r.id: r.m2 for r in geometry.polygon_areas(frame, "id").collect()}
    assert all(both[k, k] == pytest.approx(area[k]) for k in ODD_SHAPES)
    covered = zonal.coverage(frame, "id", G).collect()
    for k, rings in ODD_SHAPES.items():
        own = {(r.row, r.col): r.coverage for r in covered if r.id == k}
        for row in range(10):
            for col in range(10):
                cell = [[(col, 9 - row), (col + 1, 9 - row), (col + 1, 10 - row), (col, 10 - row)]]
                assert own.get((row, col), 0.0) == pytest.approx(shared_area(cell, rings), abs=0.01), (k, row, col)
    edge = shapes(spark, [("over", ring((-3, -2), (2.5, -2), (2.5, 12), (-3, 12)))])
    assert {(r.row, r.col): r.coverage for r in zonal.coverage(edge, "id", G).collect()} == {(r, c): 1.0 if c < 2 else 0.5 for r in range(10) for c in range(3)}


def test_national_grid(spark):
    """A published worked example (Caister water tower), to the few metres of the datum shift."""
    east, north = geometry.to_national_grid(F.lit(1.716073973), F.lit(52.658007833))
    r = one(spark, e=east, n=north)
    assert r.e == pytest.approx(651409.8, abs=5) and r.n == pytest.approx(313177.3, abs=5)
    back = spark.range(1).select(geometry.from_national_grid(F.lit(r.e), F.lit(r.n)).alias("p")).first().p
    assert back.lon == pytest.approx(1.716073973, abs=2e-6) and back.lat == pytest.approx(52.658007833, abs=2e-6)


def test_zonal_sums_of_a_partition_are_the_total(spark):
    zones = shapes(spark, [("a", ring((0, 0), (4, 0), (4, 10), (0, 10))), ("b", ring((4, 0), (10, 0), (10, 10), (4, 10)))])
    cells = spark.range(100).select(F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("v"))
    got = zonal.zonal(cells, geometry.cells_by_centre(zones, "id", G), "id", "v")
    assert got.agg(F.sum("sum")).first()[0] == cells.agg(F.sum("v")).first()[0]


def test_modes(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, "a"), ("k", 4, "b"), ("k", 5, " "), ("k", 6, None), ("z", 7, "")], "k string, n int, v string")
    assert pairs(zonal.mode_first(df, ["k"], "v", "n"), "k", "v") == [("k", "b")]
    got = {r.k: (r.m, r.u) for r in df.groupBy("k").agg(zonal.mode_smallest(F.col("v")).alias("m"), zonal.uniques_sorted(F.col("v")).alias("u")).collect()}
    assert got == {"k": ("a", ["a", "b"]), "z": (None, [])}


# ---- scenarios and vulnerability


def test_changes_are_by_key(spark):
    long = spark.createDataFrame([("u", 1, "s1", 5.0), ("u", 1, "s0", 2.0), ("v", 1, "s1", 9.0), ("u", 2, "s0", 7.0)], "unit string, year int, lc_scenario string, value double").repartition(3)
    got = {tuple(r)[:3]: r.change for r in scenario.within_year_change(long, "s0").collect()}
    assert got == {("u", 1, "s1"): 3.0, ("u", 1, "s0"): 0.0, ("v", 1, "s1"): None, ("u", 2, "s0"): 0.0}
    assert {r.unit for r in scenario.change_from(long, 1, "s0").collect()} == {"u"}
    s = scenario.summary(long.union(spark.createDataFrame([("w", 1, "s1", None)], long.schema)), ["year"], "value").where("year = 1").first()
    assert s.n == 4 and s["mean"] == pytest.approx(16 / 3)


def test_ranks_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, 9.0)], "id int, m double")
    got = {r.id: (r.p, r.d) for r in order.with_ranks(df, "m", percent="p", dense_desc="d").collect()}
    assert got[4] == (None, None) and got[5] == (1.0, 1) and got[3] == (pytest.approx(1 / 3), 2)


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_order_statistics_against_windows(spark, by):
    """Many ranges, ties, nulls and a null group; as windows over whole groups and exact percentiles give them."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("h"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(400)).cast("double")).alias("m")).repartition(6)
    keyed = lambda rows: {(tuple(r[c] for c in by), r.id if "id" in r else None): r for r in rows}
    w = lambda *o: Window.partitionBy(*by, F.col("m").isNull()).orderBy(*o)
    want = keyed(df.withColumns({"p": F.when(F.col("m").isNotNull(), F.percent_rank().over(w("m"))), "d": F.when(F.col("m").isNotNull(), F.dense_rank().over(w(F.desc("m")))), "k": F.row_number().over(Window.partitionBy(*by).orderBy("m", "id"))}).collect())
    got = keyed(order.with_places(order.with_ranks(df, "m", by, "p", "d"), ["m", "id"], by, "k").collect())
    assert len(got) == 3000 and all((r.d, r.k) == (want[i].d, want[i].k) and r.p == (want[i].p and pytest.approx(want[i].p)) for i, r in got.items())
    shares = {"a": 0.0, "b": 0.025, "c": 1 / 3, "d": 0.5, "e": 0.999, "f": 1.0}
    exact = keyed(df.groupBy(*by).agg(*[F.percentile("m", p).alias(k) for k, p in shares.items()]).collect())
    found = keyed(order.quantiles(df, "m", shares, by).collect())
    assert set(found) == set(exact) and all(found[i][k] == pytest.approx(exact[i][k]) for i in exact for k in shares)


def test_order_of_few_rows(spark):
    none = spark.createDataFrame([], "id int, g int, m double")
    assert order.with_ranks(none, "m", ["g"], "p").count() == 0 and order.quantiles(none, "m", {"a": 0.5}).first() is None or order.quantiles(none, "m", {"a": 0.5}).first().a is None
    one_ = spark.createDataFrame([(1, 1, 4.0), (2, 2, None)], none.schema)
    assert sorted((r.g, r.a) for r in order.quantiles(one_, "m", {"a": 0.3}, ["g"]).collect()) == [(1, 4.0), (2, None)]
    assert {r.id: r.b for r in vulnerability.with_bucket(one_, "m", 5, "id", "b").collect()} == {1: 1, 2: None}


def test_buckets_are_those_of_ntile(spark):
    for rows, n in ((23, 5), (3, 5), (10, 5)):
        df = spark.range(rows).select("id", (F.col("id") % 4).cast("double").alias("m"))
        want = {r.id: r.b for r in df.select("id", F.ntile(n).over(Window.orderBy("m", "id")).alias("b")).collect()}
        assert {r.id: r.b for r in vulnerability.with_bucket(df, "m", n, "id", "b").collect()} == want


def test_quintiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "m double")
    got = {r.m: r.q for r in vulnerability.quantile_bin(df, "m", 5, "q").collect()}
    assert [got[float(x)] for x in range(11)] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    ties = spark.createDataFrame([(0.0,)] * 8 + [(1.0,), (2.0,), (None,)], "m double")
    few = {r.m: r.q for r in vulnerability.quantile_bin(ties, "m", 5, "q", rank_fallback=False).collect()}
    assert few[0.0] == 1 and few[None] is None and few[2.0] == max(v for v in few.values() if v)


def test_pairing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (3, "a", 1.0), (3, "a", 1.0), (3, "b", 1.0)], "id int, lc_scenario string, cases double")
    assert pairs(vulnerability.pairing_violations(df, "id", ["a", "b"]), "id", "lc_scenario", "n") == [(2, "b", 0), (3, "a", 2)]
    same = vulnerability.benefit_classes(spark.createDataFrame([(1, 1.0, 2.0)], "id int, cases_first double, cases_second double"))
    assert same.first().benefit_first is None  # equal tertiles


# ---- statistics


def test_tails(spark):
    r = one(spark, t=stats.t_p_value(F.lit(2.0), F.lit(10.0)), z=stats.z_p_value(F.lit(1.959964)), c=stats.chi2_p_value(F.lit(5.991465), F.lit(2.0)), f=stats.f_p_value(F.lit(4.102821), F.lit(2.0), F.lit(10.0)), none=stats.z_p_value(F.lit(None).cast("double")))
    assert r.t == pytest.approx(0.07338803) and r.z == pytest.approx(0.05, abs=1e-6) and r.c == pytest.approx(0.05, abs=1e-6) and r.f == pytest.approx(0.05, abs=1e-6) and r.none is None


def test_rank_tests_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0), ("b", None)], "g string, v double")
    w = stats.rank_sum(df, "g", "v").first()
    assert w.w == 1.0  # of nine pairs none is won, two are ties
    h = stats.kruskal(df, "g", "v").first()
    assert h.df == 1 and h.h == pytest.approx((12 / 42 * (49 / 3 + 196 / 3) - 21) / (1 - 24 / 210))


def test_curves(spark):
    df = spark.range(400).select(F.lit("m").alias("metric"), (F.col("id") / 40).alias("x"), F.sin(F.col("id") / 40).alias("y"))
    curve, fit = stats.spline_curves(df, 10)
    assert max(abs(r.fitted - math.sin(r.x)) for r in curve.collect()) < 0.05
    f = fit.first()
    assert 4 < f.edf <= 10 and f.aic < f.aic_linear
    d = stats.density(spark.range(1000).select((F.col("id") % 100).cast("double").alias("v")), "v", 101)
    assert d.count() == 101 and d.agg(F.sum("density")).first()[0] * 99 / 100 == pytest.approx(0.95, abs=0.06)


# ---- observations, trees, profiles, sources


def test_intervals_keep_ties(spark):
    day = dt.date(2021, 5, 10)
    events = spark.createDataFrame([("k", day)], "k string, at date")
    spans = spark.createDataFrame([("k", day - dt.timedelta(3), day), ("k", day - dt.timedelta(3), day + dt.timedelta(9)), ("k", day - dt.timedelta(8), day), ("k", day + dt.timedelta(1), day + dt.timedelta(2))], "k string, s date, e date")
    assert observations.interval_nearest(events, spans, "k", "at", "s", "e").count() == 2
    assert [r[0] for r in spark.createDataFrame([("0.1", "51"), ("x", "51"), (None, "51"), ("3", "51")], "lon string, lat string").select(observations.in_box(F.col("lon"), F.col("lat"), (-2, 50, 2, 53))).collect()] == [True, False, False, False]


def test_daytime_hours(spark):
    t = [dt.datetime(2021, 1, 31, h, 30) for h in (7, 8, 19, 20)]
    obs = spark.createDataFrame([("s", x, float(x.hour)) for x in t], "station string, ts timestamp, v double")
    daily = observations.daily_day_night(obs, "station", "ts", "v")
    assert pairs(daily, "day_night", "mean") == [("day", 13.5), ("night", 13.5)]
    assert observations.monthly_daytime(daily, "station").first()["mean"] == 13.5


def test_names_match_in_two_passes(spark):
    own = spark.createDataFrame([(1, "Acer"), (2, "Bcer"), (3, "Zzz"), (4, None)], "id int, taxon string")
    known = spark.createDataFrame([("Acer",), ("Betula",)], "species string")
    table = spark.createDataFrame([("Bcer", "Betula"), ("Zzz", "Unknown")], "taxon string, species string")
    got = {r.id: (r.matched, r.method) for r in trees.match_names(own, known, table, "taxon", "species", "id").collect()}
    assert got == {1: ("Acer", "exact"), 2: ("Betula", "resolved"), 3: (None, None), 4: (None, None)}


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, None, 3.0)], "k int, v string, w double")
    assert pairs(profile.duplicate_keys(df, ["k"]), "k", "n") == [(1, 2)]
    assert pairs(profile.missing_profile(df, ["v", "w"]), "name", "missing") == [("v", 1), ("w", 1)]
    assert profile.unique_names(df.toDF("x", "x", "x_1")).columns == ["x", "x_2", "x_1"]
    assert profile.select_matching(df, "^[kv]", "v").columns == ["k"]
    assert pairs(profile.frequency(df, "v"), "v", "n") == [("Unknown", 1), ("a", 1), ("b", 1)]
    assert pairs(profile.set_operation(df.select("k"), df.select("k").where("k = 1"), "subtract"), "k") == [(2,)]
    assert profile.sample_per_layer(df, "k", 1).count() == 2
    safe = profile.export_safe(df.select(F.array("k").alias("fid"), (F.col("k") > 1).alias("b"), F.lit(dt.date(2020, 1, 2)).alias("d")))
    assert tuple(safe.orderBy("d").first()) [2] == "2020-01-02" and safe.columns == ["fid_1", "b", "d"] and dict(safe.dtypes)["b"] == "tinyint"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s0_s1_2021.csv").write_text("id,v\n1,2.5\n")
    (tmp_path / "s0_s2_2050.csv").write_text("id,v\n2,x\n")
    rows = readers.csv_files(spark, str(tmp_path), "id int, v double", {"scenario": (r"s0_(s\d)", 1), "year": (r"_(\d{4})\.", 1), "none": ("(zz)", 1)}, "*.csv")
    assert pairs(rows.na.fill(-1.0), "id", "v", "scenario", "year") == [(1, 2.5, "s1", "2021"), (2, -1.0, "s2", "2050")]
    (tmp_path / "t.tsv").write_text("A\tBc\n1\tx\n")
    assert readers.tsv(spark, str(tmp_path / "t.tsv")).columns == ["a", "bc"]
    (tmp_path / "p.txt").write_text("junk\nmore, junk\nid,temp\n7,1.5\n8,bad\n")
    assert pairs(readers.csv_after_preamble(spark, str(tmp_path / "p.txt"), {"id": "int", "temp": "double"}, 2).na.fill(-1.0), "id", "temp") == [(7, 1.5), (8, -1.0)]
    (tmp_path / "m.csv").write_text('id,n\n1,"two\nlines ""q"""\n')
    assert readers.multiline_csv(spark, str(tmp_path / "m.csv"), "id int, n string").first().n == 'two\nlines "q"'
    (tmp_path / "kv.txt").write_text("panoID: abc lat: 1.5\n")
    assert tuple(readers.key_value_lines(spark, str(tmp_path / "kv.txt"), ["panoID", "lat", "x"]).first()) == ("abc", "1.5", None)
    (tmp_path / "c.json").write_text('[{"name": "a", "rr_1c": 1.1}]')
    assert readers.causes(spark, str(tmp_path / "c.json")).first().rr_1c == 1.1
    meta = spark.createDataFrame([('{"status": "OK", "location": {"lat": 1.0, "lng": 2.0}}',), ('{"status": "ZERO_RESULTS"}',), (None,)], "json string")
    assert readers.image_metadata(meta).count() == 1
    cells = spark.createDataFrame([("l", 0, 0, -9999.0), ("l", 0, 1, float("nan")), ("l", 0, 2, 1.0), ("x", 0, 2, 1.0)], "layer string, row int, col int, value double")
    sinks.parquet(cells, str(tmp_path / "cells"), ["layer"])
    assert [r.value for r in readers.cells(spark, str(tmp_path / "cells"), ["l"], -9999.0).orderBy("col").collect()] == [None, None, 1.0]
    out = sinks.csv_with_totals(spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int"), str(tmp_path / "out"), "name", {"source": "x"})
    assert pairs(out, "name", "n") == [("Total", 3), ("a", 1), ("b", 2)]
    assert spark.read.json(str(tmp_path / "out_about")).first().source == "x"


def test_values_within(spark):
    df = spark.createDataFrame([("m", float(x)) for x in range(101)], "metric string, value double")
    assert vulnerability.quantile_trim(df).count() == 99
    code = vulnerability.row_mean(["a", "b"])
    assert spark.createDataFrame([(1.0, None)], "a double, b double").select(code).first()[0] == 1.0


def test_nearest_within_agrees_with_brute_force(spark):
    """A many-edged polygon, points inside, near and far; no window, which would rank a polygon's points in one task."""
    ring = [((30 + k % 2 * 8) * math.cos(k * math.pi / 30), (40 + k % 3 * 5) * math.sin(k * math.pi / 30)) for k in range(60)]
    zones = {1: ring, 2: [(60.0, 0.0), (80.0, 0.0), (80.0, 3.0), (60.0, 3.0)], 3: [(300.0, 300.0), (310.0, 300.0), (310.0, 310.0)]}
    spots = [(i, i * 37 % 200 - 80 + 0.03, i * 91 % 130 - 60 + 0.07) for i in range(120) if not (i % 3 and 40 < i * 37 % 200 < 100)]
    spots = [s for s in spots if not (60 < s[1] < 80 and 0 < s[2] < 3)] + [(1000, 300.0, 304.0), (1001, 70.0, 3.25), (1002, 70.0, -0.25)]

    def distance(x, y, corners):
        out, odd = math.inf, False
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
            t = min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1)
            out = min(out, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return 0.0 if odd else out

    want = set()
    for zone, corners in zones.items():
        away = {i: round(distance(x, y, corners), 9) for i, x, y in spots}
        want |= {(zone, i, a) for i, a in away.items() if a <= 5 and a == min(away.values())}
    assert {z for z, *_ in want} == {1, 2, 3}
    frame = spark.createDataFrame(spots, "p long, x double, y double")
    polygons = spark.createDataFrame([(z, [[{"x": x, "y": y} for x, y in c]]) for z, c in zones.items()], "id long, rings array<array<struct<x:double,y:double>>>")
    got = geometry.nearest_within(frame, polygons, "p", "id", 5.0)
    assert {(r.id, r.p, round(r.distance, 9)) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_whole_tables_are_registered(spark, sf_dir):
    """All points and orders come in."""
    assert queries.nearest_points(spark, sf_dir).where("id % 50 <> 3").count()
    assert queries.nearest_fallback(spark, sf_dir).agg({"n": "sum"}).first()[0] > 50
    assert queries.season_match(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert queries.interval_nearest(spark, sf_dir).where("days > 0").count()


def tail(density, x, top=400.0, n=2_000_000):
    """By Simpson's rule over u = t / (1 + t)."""
    a, b = x / (1 + x), 1 - 1e-9
    u = np.linspace(a, b, n + 1)
    y = density(u / (1 - u)) / (1 - u) ** 2
    return float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (b - a) / n / 3)


def test_tails_against_integrals(spark):
    lg = math.lgamma
    t = lambda v: lambda x: np.exp(lg((v + 1) / 2) - lg(v / 2)) / np.sqrt(v * np.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    chi2 = lambda k: lambda x: np.exp((k / 2 - 1) * np.log(np.maximum(x, 1e-300)) - x / 2 - lg(k / 2) - k / 2 * np.log(2))
    f = lambda a, b: lambda x: np.exp(lg((a + b) / 2) - lg(a / 2) - lg(b / 2) + a / 2 * np.log(a / b) + (a / 2 - 1) * np.log(np.maximum(x, 1e-300)) - (a + b) / 2 * np.log1p(a / b * x))
    r = one(spark, t=stats.t_p_value(F.lit(2.1), F.lit(7.0)), c=stats.chi2_p_value(F.lit(9.3), F.lit(4.0)), f=stats.f_p_value(F.lit(3.3), F.lit(3.0), F.lit(20.0)), q=stats.t_quantile(F.lit(0.975), F.lit(10.0)), z=stats.z_p_value(F.lit(1.959963984540054)))
    assert r.t == pytest.approx(2 * tail(t(7), 2.1), rel=1e-6) and r.c == pytest.approx(tail(chi2(4), 9.3), rel=1e-6) and r.f == pytest.approx(tail(f(3, 20), 3.3), rel=1e-6)
    assert r.q == pytest.approx(2.228138852, abs=1e-8) and r.z == pytest.approx(0.05, abs=1e-12)


def test_preambles_of_files_in_several_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("junk\nx\n\nid,v\n" + "".join(f"{i},{i}.5\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.csv_after_preamble(spark, str(tmp_path), {"id": "int", "v": "double"}, 3)
        assert rows.rdd.getNumPartitions() > 2 and sorted(r.id for r in rows.collect()) == sorted(2 * list(range(2000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_short_names_are_found_once_for_each_path(spark, sf_dir):
    """Paths are counted before their forms are found, and again by form."""
    own = queries.QUERIES["short_name_forms"](spark, sf_dir)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
    assert sum(r.n for r in own.collect()) == spark.read.parquet(f"{sf_dir}/part.parquet").count()
