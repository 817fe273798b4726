"""Squares over polygons: the same pairs as by testing all edges, and rows that follow the outline."""

import math
import random

import pytest
from heatgrid.operators import geometry, quadtree
from pyspark.sql import functions as F


def star(r, x, y, size, n, whole=False, low=0.3):
    out = []
    for i in range(n):
        far, turn = size * r.uniform(low, 1), 2 * math.pi * i / n
        p = (x + far * math.cos(turn), y + far * math.sin(turn))
        out.append(tuple(float(round(c)) for c in p) if whole else p)
    return out


def state(px, py, rings):
    """(crossings are odd, on an edge)."""
    odd = on = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            on |= (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2)
            odd ^= (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
    return odd, on


def frame(spark, polygons):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in polygons.items()]
    return spark.createDataFrame(rows, "id int, rings array<array<struct<x:double,y:double>>>")


@pytest.fixture(scope="module")
def layers():
    r = random.Random(5)
    polygons = {i: [star(r, r.uniform(-50, 50), r.uniform(-50, 50), r.choice([3, 20, 60]), r.choice([3, 5, 40, 150]))] for i in range(10)}
    # corners, edges and points on whole numbers, so that many lie on lines of the lattice and on each other
    polygons |= {i: [star(r, r.randint(-20, 20), r.randint(-20, 20), r.choice([4, 16]), r.choice([4, 8, 30]), True) for _ in range(r.choice([1, 2]))] for i in range(10, 20)}
    polygons[20] = [[(-32.0, -32.0), (32.0, -32.0), (32.0, 32.0), (-32.0, 32.0)]]
    points = [(j, r.uniform(-80, 80), r.uniform(-80, 80)) for j in range(600)] + [(j, float(r.randint(-34, 34)), float(r.randint(-34, 34))) for j in range(600, 1600)]
    return polygons, points


@pytest.mark.parametrize("most", [2, 16, 1000])
def test_pairs_equal_brute_force(spark, layers, most):
    polygons, points = layers
    places = spark.createDataFrame(points, "p int, x double, y double")
    states = {(j, k): state(x, y, rings) for k, rings in polygons.items() for j, x, y in points}
    for covers in (False, True):
        got = [(r.p, r.id) for r in geometry.points_in_polygons(places, frame(spark, polygons), "p", "id", covers, most).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {k for k, (odd, on) in states.items() if (odd or on if covers else odd and not on)}


def test_rows_follow_the_outline_not_the_area(spark):
    """Sides grow by 16, the outline's edges stay: so do the squares. With twice the edges there are about twice as many."""
    r = random.Random(1)
    shape = star(r, 0, 0, 100, 2000, low=0.99)
    sizes = []
    for scale, ring in ((1, shape), (16, [(16 * x, 16 * y) for x, y in shape]), (16, [(16 * x, 16 * y) for x, y in shape[::2]])):
        index = quadtree.quadtree(frame(spark, {1: [ring]}), "id")
        sizes.append((index.count(), index.agg(F.sum(F.size("edges"))).first()[0], index.agg(F.max(F.size("edges"))).first()[0], scale))
    assert sizes[0][:3] == sizes[1][:3]
    assert sizes[0][0] < 2000 and sizes[0][1] < 4 * 2000 and sizes[0][2] <= quadtree.MOST_EDGES
    assert 1.4 < sizes[0][0] / sizes[2][0] < 3.5  # squares of the area would be 4
    # a borough of 50 km with four sides is a handful of squares
    plain = quadtree.quadtree(frame(spark, {1: [[(3, 5), (50_003, 6), (50_001, 50_000), (4, 49_990)]]}), "id")
    assert plain.count() <= 4 and plain.agg(F.sum(F.size("edges"))).first()[0] <= 16


def test_squares_inside_carry_no_edges(spark):
    circle = [(1000 * math.cos(t / 300 * math.tau), 1000 * math.sin(t / 300 * math.tau)) for t in range(300)]
    index = quadtree.quadtree(frame(spark, {1: [circle]}), "id")
    rows = index.collect()
    area = lambda keep: sum(4.0 ** r.level for r in rows if keep(r))
    inner = area(lambda r: not r.edges)
    assert all(r.inside for r in rows if not r.edges)
    assert 0.5 * math.pi * 1e6 < inner < math.pi * 1e6 < inner + area(lambda r: r.edges)


def test_boxes_that_meet(spark):
    r = random.Random(3)
    draw = lambda n: [(i, x, y, x + w, y + h) for i, x, y, w, h in ((i, r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.3, 4, 40]) * r.random() + 0.01, r.choice([0.3, 4, 40]) * r.random() + 0.01) for i in range(n))]
    a, b = draw(60), draw(60)

    def table(rows, p):
        df = spark.createDataFrame(rows, f"{p} int, {p}xmin double, {p}ymin double, {p}xmax double, {p}ymax double")
        return df.withColumn(f"{p}box_level", quadtree.level_of(F.greatest(F.col(f"{p}xmax") - F.col(f"{p}xmin"), F.col(f"{p}ymax") - F.col(f"{p}ymin"))))

    got = [(x.a, x.b) for x in quadtree.meeting_boxes(table(a, "a"), table(b, "b")).collect()]
    assert sorted(got) == sorted((i, j) for i, x1, y1, x2, y2 in a for j, u1, v1, u2, v2 in b if x1 <= u2 and u1 <= x2 and y1 <= v2 and v1 <= y2)


# ---- rings


def test_depth_of_rings_in_any_order_and_direction(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    nest = {"outer": square(0, 0, 10), "hole": square(1, 1, 6), "island": square(2, 2, 3), "pond": square(3, 3, 1), "apart": square(20, 0, 2), "corner": square(7, 7, 3)}
    depth = {"outer": 0, "hole": 1, "island": 2, "pond": 3, "apart": 0, "corner": 1}
    holder = {"hole": "outer", "island": "hole", "pond": "island", "corner": "outer"}
    r = random.Random(8)
    for turn in range(3):
        names = r.sample(list(nest), len(nest))
        rings = [nest[n] if r.random() < 0.5 else nest[n][::-1] for n in names]
        found = {names[x.k]: x for x in geometry.ring_table(frame(spark, {1: rings, 2: [square(1, 1, 100)]}), "id").where("id = 1").collect()}
        assert {n: x.depth for n, x in found.items()} == depth
        assert {n: names[x.outer] for n, x in found.items() if x.outer is not None} == holder
        assert {x.id: x.m2 for x in geometry.polygon_areas(frame(spark, {1: rings}), "id").collect()} == {1: 100 - 36 + 9 - 1 + 4 - 9}
        own = {x.m2 for x in geometry.parts(frame(spark, {1: rings}), "id").collect()}
        assert own == {100 - 36 - 9, 9 - 1, 4}
        assert sorted(x.m2 for x in geometry.drop_small_parts(frame(spark, {1: rings}), "id", 5.0).collect()) == [8, 55]


def test_areas_of_large_coordinates_and_odd_features(spark):
    far = [(530_000.125 + x, 180_000.25 + y) for x, y in ((0, 0), (0.5, 0), (0.5, 0.75), (0, 0.75))]
    polygons = {1: [far], 2: [], 3: [[(0, 0), (1, 1)]], 4: [far, far], 5: [[(0, 0), (2, 0), (4, 0)]], 6: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(6, 6), (8, 6), (8, 8), (6, 8)]]}
    assert {r.id: r.m2 for r in geometry.polygon_areas(frame(spark, polygons), "id").collect()} == {1: 0.375, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 20.0}
    own = {r.id: (r.m2, r.cx, r.cy) for r in geometry.polygon_centroids(frame(spark, {6: polygons[6], 1: [far]}), "id").collect()}
    assert own[1] == pytest.approx((0.375, 530_000.375, 180_000.625)) and own[6] == pytest.approx((20, (16 * 2 + 4 * 7) / 20, (16 * 2 + 4 * 7) / 20))
    assert geometry.total_area(frame(spark, {}), "id").first().m2 == 0


def test_one_zone_of_two_parts_is_the_same_everywhere(spark):
    from heatgrid.operators import zonal
    from heatgrid.operators.grid import Grid

    zone = frame(spark, {1: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(6, 6), (6, 8), (8, 8), (8, 6)]]})
    whole = frame(spark, {9: [[(-1, -1), (11, -1), (11, 11), (-1, 11)]]}).withColumnRenamed("id", "f")
    grid = Grid(0.0, 10.0, 1.0, 1.0, 10, 10)
    assert geometry.total_area(zone, "id").first().m2 == 20
    assert geometry.overlay_area(whole, zone, "f", "id").first().m2 == pytest.approx(20)
    assert zonal.coverage(zone, "id", grid).agg(F.sum("coverage")).first()[0] == pytest.approx(20)
    assert geometry.cells_by_centre(zone, "id", grid).count() == 20
