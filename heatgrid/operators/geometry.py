"""Points and polygons as tables.

Polygons are rows with rings, an array of arrays of (x, y) structs, of parts and holes in any order and direction: inside is
counted by crossings, and what a ring adds to an area by how many others hold it. Polygons meet points and each other in
squares that grow with them (`quadtree`), so that joins are equi-joins.
"""

from __future__ import annotations

from math import radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.operators import quadtree
from heatgrid.operators.grid import Grid
from heatgrid.operators.quadtree import edges
from heatgrid.sources.sinks import parquet, scratch


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_key: str, key: str, covers: bool = False, most_edges: int = quadtree.MOST_EDGES) -> DataFrame:
    """(point, polygon) pairs where the polygon has the point; points on an edge count only with covers.

    Polygons are covered by squares that follow their outline; a point meets one square of each size, and the edges of
    that square alone.
    """
    own = points.select(point_key, F.col("x").alias("px"), F.col("y").alias("py"))
    return quadtree.matches(own, quadtree.quadtree(polygons, key, most_edges), key, covers).select(point_key, key)


def polygons_with_points(polygons: DataFrame, points: DataFrame, key: str, point_key: str) -> DataFrame:
    """All polygons, a row for each point they cover, one with null for those without."""
    return polygons.select(key).join(points_in_polygons(points, polygons, point_key, key, True), key, "left")


def nearest_within(points: DataFrame, polygons: DataFrame, point_key: str, key: str, limit: float, size: float = 10.0) -> DataFrame:
    """For each polygon the points nearest to its outline or inside, at most `limit` away; ties are all kept.

    Boxes, widened by the limit, stand in squares of their own size. Edges are dealt into bands of y: a point meets those
    at its height and those near enough.
    """
    own = edges(polygons, key)
    near = quadtree.near_points(points.select(point_key, F.col("x").alias("px"), F.col("y").alias("py")), quadtree.boxes(own, key, limit))
    banded = own.withColumn("band", F.explode(_span(F.least("y1", "y2") - limit, F.greatest("y1", "y2") + limit, size)))
    near = near.withColumn("band", F.floor(F.col("py") / size)).join(banded, [key, "band"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.least(F.greatest(((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    away = F.sqrt(F.pow(F.col("px") - F.col("x1") - t * dx, 2) + F.pow(F.col("py") - F.col("y1") - t * dy, 2))
    crosses = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < dx * (F.col("py") - F.col("y1")) / dy + F.col("x1"))
    found = near.groupBy(key, point_key).agg(F.min(away).alias("outline"), F.count_if(crosses).alias("n"))
    found = found.withColumn("distance", F.when(F.col("n") % 2 == 1, 0.0).otherwise(F.col("outline"))).where(F.col("distance") <= limit)
    return found.join(found.groupBy(key).agg(F.min("distance").alias("distance")), [key, "distance"]).select(key, point_key, "distance")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, count: str, values: list[str]) -> DataFrame:
    """The fallback's values where the primary counts none and the fallback some; `method` says which, null for neither."""
    second = fallback.select(key, *[F.col(c).alias(f"fb_{c}") for c in (count, *values)])
    both = primary.join(second, key, "left")
    none = F.coalesce(count, F.lit(0)) == 0
    use = none & (F.coalesce(f"fb_{count}", F.lit(0)) > 0)
    out = {c: F.when(use, F.col(f"fb_{c}")).otherwise(F.col(c)) for c in (count, *values)}
    return both.withColumn("method", F.when(use, "nearest").when(~none, "pip")).withColumns(out).drop(*[f"fb_{c}" for c in (count, *values)])


def in_extent(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose box (columns xmin, ymin, xmax, ymax) meets an extent; those without a geometry go."""
    return features.where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))


# ---- rings and area


def _ring_sum(ring: Column, term) -> Column:
    """Sum of term(p, q) over the edges of a ring, from its first point as the origin, so that large coordinates cost no digits."""
    first = F.get(ring, F.lit(0))
    moved = F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    return F.get(F.transform(F.array(moved), lambda r: F.aggregate(F.transform(r, lambda p, i: term(p, F.get(r, (i + 1) % F.size(r)))), F.lit(0.0), lambda a, x: a + x)), F.lit(0))


def ring_area(ring: Column) -> Column:
    """Signed area, positive counter-clockwise."""
    return _ring_sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    area, first = ring_area(ring), F.get(ring, F.lit(0))
    part = lambda axis: first[axis] + _ring_sum(ring, lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])) / (6 * area)
    return part("x"), part("y")


def _inner_point(ring: Column) -> Column:
    """A point inside a ring: between its first two crossings with the level line halfway between its two lowest heights."""

    def at(r: Column) -> Column:
        heights = F.array_sort(F.array_distinct(F.transform(r, lambda p: p["y"])))
        y = (F.get(heights, F.lit(0)) + F.get(heights, F.lit(1))) / 2

        def crossing(p: Column, i: Column) -> Column:
            q = F.get(r, (i + 1) % F.size(r))
            return F.when((p["y"] > y) != (q["y"] > y), p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]))

        xs = F.array_sort(F.array_compact(F.transform(r, crossing)))
        return F.struct(((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2).alias("x"), y.alias("y"))

    return F.get(F.transform(F.array(ring), at), F.lit(0))


def ring_table(features: DataFrame, key: str) -> DataFrame:
    """(key, k, r, m2, depth, outer): the rings of features that have an area, by their number, with how many other rings of the feature hold them and the smallest that does.

    Rings do not cross, but they may touch and come in any order and direction. A ring is held by another that is larger
    and has a point of its inside; of equal rings the later is held by the earlier. Rings of even depth add area, those of
    odd depth are holes: parts, holes, islands in holes. Where a feature has several, the table is written once in the
    shared folder, as areas, boxes and edges all come from it.
    """
    own = features.select(key, F.size("rings").alias("n"), F.posexplode("rings").alias("k", "r")).where(F.size("r") > 2).withColumn("m2", F.abs(ring_area(F.col("r")))).where("m2 > 0")
    single = lambda df: df.select(key, "k", "r", "m2", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("int").alias("outer"))
    if features.where(F.size("rings") > 1).isEmpty():
        return single(own)
    alone, rings = single(own.where("n = 1")), own.where("n > 1")
    shells = rings.select(F.col(key).alias("__of"), F.struct(F.col(key).alias("of"), "k", "m2").alias("__shell"), F.array("r").alias("rings"))
    index = quadtree.quadtree(shells, "__shell").withColumn("__of", F.col("__shell.of"))
    inner = rings.select(F.col(key).alias("__of"), "k", "m2", _inner_point(F.col("r")).alias("__p"))
    inner = inner.select("__of", "k", "m2", F.col("__p.x").alias("px"), F.col("__p.y").alias("py"))
    held = quadtree.matches(inner, index, "__shell", True, "__of")
    held = held.where((F.col("__shell.m2") > F.col("m2")) | ((F.col("__shell.m2") == F.col("m2")) & (F.col("__shell.k") < F.col("k"))))
    held = held.groupBy(F.col("__of").alias(key), "k").agg(F.count("*").alias("depth"), F.min(F.struct("__shell.m2", (-F.col("__shell.k")).alias("minus_k"))).alias("__least"))
    nested = rings.join(held, [key, "k"], "left").select(key, "k", "r", "m2", F.coalesce("depth", F.lit(0)).alias("depth"), (-F.col("__least.minus_k")).cast("int").alias("outer"))
    return parquet(alone.unionByName(nested), f"{scratch(features.sparkSession)}/rings")


def _sign(depth: Column) -> Column:
    return F.when(depth % 2 == 0, 1.0).otherwise(-1.0)


def polygon_areas(features: DataFrame, key: str) -> DataFrame:
    """(key, m2) of all features: parts less holes; 0 without a ring that has an area."""
    own = ring_table(features, key).groupBy(key).agg(F.sum(_sign(F.col("depth")) * F.col("m2")).alias("m2"))
    return features.select(key).join(own, key, "left").na.fill(0.0, ["m2"])


def polygon_centroids(features: DataFrame, key: str) -> DataFrame:
    """(key, m2, cx, cy): area and centroid of whole features, parts, holes and islands; features without an area go."""
    cx, cy = ring_centroid(F.col("r"))
    own = ring_table(features, key).select(key, (_sign(F.col("depth")) * F.col("m2")).alias("a"), cx.alias("x"), cy.alias("y"))
    mean = lambda c: F.sum(F.col("a") * F.col(c)) / F.sum("a")
    return own.groupBy(key).agg(F.sum("a").alias("m2"), mean("x").alias("cx"), mean("y").alias("cy"))


def total_area(polygons: DataFrame, key: str) -> DataFrame:
    m2 = F.coalesce(F.sum("m2"), F.lit(0.0))
    return polygon_areas(polygons, key).agg(m2.alias("m2"), (m2 / 1e6).alias("km2"))


def parts(features: DataFrame, key: str) -> DataFrame:
    """(key, part, rings, m2): each part of a feature with its holes, as a polygon of its own; an island in a hole is a part."""
    own = ring_table(features, key).withColumn("part", F.when(F.col("depth") % 2 == 0, F.col("k")).otherwise(F.col("outer")))
    ring = F.struct((F.col("depth") % 2).alias("hole"), "k", "r")
    rings = F.transform(F.array_sort(F.collect_list(ring)), lambda x: x["r"])
    return own.groupBy(key, "part").agg(rings.alias("rings"), F.sum(_sign(F.col("depth")) * F.col("m2")).alias("m2"))


def drop_small_parts(features: DataFrame, key: str, least_m2: float = 0.5) -> DataFrame:
    """The parts of features that have at least that area."""
    return parts(features, key).where(F.col("m2") >= least_m2)


def signed_edges(features: DataFrame, key: str) -> DataFrame:
    """Edges with a sign: counter-clockwise ones count in (1) in parts, clockwise ones in holes."""
    sign = F.signum(ring_area(F.col("r"))) * _sign(F.col("depth"))
    ring = ring_table(features, key).select(F.struct(key, sign.alias("sign")).alias("of"), F.array("r").alias("rings"))
    own = edges(ring, "of")
    return own.select(F.col(f"of.{key}").alias(key), F.col("of.sign").alias("sign"), "x1", "y1", "x2", "y2")


def overlay_area(features: DataFrame, zones: DataFrame, key: str, zone_key: str, size: float = 10.0) -> DataFrame:
    """Area of each feature in each zone that it meets; both may have parts and holes, be concave and turn either way.

    A polygon is the signed sum of the areas under its edges, so two polygons share the signed sum of the areas under both
    of an edge of each. Boxes meet in squares of the larger one's size; edges meet in bands of x, so that a feature meets
    only those edges of a zone that lie above or below it. Less than 1e-9 of the feature's area is none.
    """
    f, z = signed_edges(features, key), signed_edges(zones, zone_key)
    of = lambda df, k, p: quadtree.boxes(df, k).select(k, *[F.col(c).alias(f"{p}{c}") for c in ("xmin", "xmax", "ymin", "ymax", "box_level")])
    pairs = quadtree.meeting_boxes(of(f, key, "a"), of(z, zone_key, "b"))
    pairs = pairs.select(key, zone_key, F.least("aymin", "bymin").alias("floor"))

    def banded(df: DataFrame, k: str, p: str) -> DataFrame:
        own = df.where("x1 <> x2").select(
            k, F.least("x1", "x2").alias(f"{p}l"), F.greatest("x1", "x2").alias(f"{p}r"), F.when(F.col("x1") < F.col("x2"), F.col("y1")).otherwise(F.col("y2")).alias(f"{p}a"),
            F.when(F.col("x1") < F.col("x2"), F.col("y2")).otherwise(F.col("y1")).alias(f"{p}b"), (F.col("sign") * F.signum(F.col("x1") - F.col("x2"))).alias(f"{p}s"),
        )
        return own.withColumn("band", F.explode(_span(F.col(f"{p}l"), F.col(f"{p}r"), size)))

    met = pairs.join(banded(f, key, "f"), key).join(banded(z, zone_key, "z"), [zone_key, "band"])
    left = F.greatest("fl", "zl", F.col("band") * F.lit(size))
    right = F.least("fr", "zr", (F.col("band") + 1) * F.lit(size))
    met = met.withColumns({"l": left, "r": right}).where("l < r")
    at = lambda p, x: F.col(f"{p}a") + (x - F.col(f"{p}l")) / (F.col(f"{p}r") - F.col(f"{p}l")) * (F.col(f"{p}b") - F.col(f"{p}a")) - F.col("floor")
    met = met.withColumns({"f0": at("f", F.col("l")), "f1": at("f", F.col("r")), "z0": at("z", F.col("l")), "z1": at("z", F.col("r"))})
    d0, d1 = F.col("f0") - F.col("z0"), F.col("f1") - F.col("z1")
    low0, low1 = F.least("f0", "z0"), F.least("f1", "z1")
    t = d0 / (d0 - d1)
    meet = F.col("f0") + t * (F.col("f1") - F.col("f0"))
    mean = F.when(d0 * d1 < 0, ((low0 + meet) * t + (meet + low1) * (1 - t)) / 2).otherwise((low0 + low1) / 2)
    part = F.col("fs") * F.col("zs") * mean * (F.col("r") - F.col("l"))
    own = f.groupBy(key).agg(F.abs(F.sum(F.col("sign") * (F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2)).alias("__whole"))
    return met.groupBy(key, zone_key).agg(F.sum(part).alias("m2")).join(own, key).where(F.col("m2") > 1e-9 * F.col("__whole")).drop("__whole")


# ---- polygons and circles to cells


def _runs_by_centre(polygons: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(row, key, c0, c1): runs of cells whose centre lies in a polygon, by scan lines: rows are cut by edges, crossings paired. Runs of a polygon do not overlap."""
    own = edges(polygons, key)
    top, bottom = F.greatest("y1", "y2"), F.least("y1", "y2")
    first, last = F.ceil((grid.y0 - top) / grid.dy - 0.5), F.floor((grid.y0 - bottom) / grid.dy - 0.5)
    rows = own.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    y = grid.y(F.col("row"))
    rows = rows.where((F.col("y1") > y) != (F.col("y2") > y)).where(F.col("row").between(0, grid.nrows - 1))
    rows = rows.withColumn("x", F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    ordered = Window.partitionBy(key, "row").orderBy("x")
    pairs = rows.select(key, "row", "x").withColumns({"n": F.row_number().over(ordered), "to": F.lead("x").over(ordered)}).where("n % 2 = 1")
    a, b = F.ceil((F.col("x") - grid.x0) / grid.dx - 0.5), F.ceil((F.col("to") - grid.x0) / grid.dx - 0.5) - 1
    a, b = F.greatest(a, F.lit(0)), F.least(b, F.lit(grid.ncols - 1))
    return pairs.where(a <= b).select(F.col("row").cast("int").alias("row"), key, a.cast("int").alias("c0"), b.cast("int").alias("c1"))


def _in_runs(runs: DataFrame, *columns: str) -> DataFrame:
    """(row, col, columns): the cells of runs."""
    return runs.select("row", F.explode(F.sequence("c0", "c1")).alias("col"), *columns)


def cells_by_centre(polygons: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(row, col, key) of the cells whose centre lies in a polygon."""
    return _in_runs(_runs_by_centre(polygons, key, grid), key)


def _runs_touched(polygons: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(row, key, c0, c1): runs of the cells that a polygon touches, those by centre and those its edges run through. Runs of a polygon do not overlap.

    In each row of a polygon runs are put in order, and each begins after all that the ones before it reach, so that cells
    are told apart before there is a row for each.
    """
    own = edges(polygons, key)
    v1, v2 = (grid.y0 - F.col("y1")) / grid.dy, (grid.y0 - F.col("y2")) / grid.dy
    u1, u2 = (F.col("x1") - grid.x0) / grid.dx, (F.col("x2") - grid.x0) / grid.dx
    own = own.select(key, u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"))
    first, last = F.greatest(F.floor(F.least("v1", "v2")), F.lit(0)), F.least(F.floor(F.greatest("v1", "v2")), F.lit(grid.nrows - 1))
    own = own.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = lambda v: F.col("u1") + (v - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))
    inside = lambda v: F.least(F.greatest(v, F.least("v1", "v2")), F.greatest("v1", "v2"))
    flat = F.col("v1") == F.col("v2")
    a = F.when(flat, F.col("u1")).otherwise(at(inside(F.col("row").cast("double"))))
    b = F.when(flat, F.col("u2")).otherwise(at(inside(F.col("row") + 1.0)))
    c0, c1 = F.greatest(F.floor(F.least(a, b)), F.lit(0)), F.least(F.floor(F.greatest(a, b)), F.lit(grid.ncols - 1))
    crossed = own.select(F.col("row").cast("int").alias("row"), key, c0.cast("int").alias("c0"), c1.cast("int").alias("c1")).where("c0 <= c1")
    before = Window.partitionBy(key, "row").orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1)
    runs = _runs_by_centre(polygons, key, grid).union(crossed).withColumn("reached", F.max("c1").over(before))
    return runs.select("row", key, F.greatest(F.col("c0"), F.col("reached") + 1).alias("c0"), "c1").where("c0 <= c1")


def cells_touched(polygons: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(row, col, key) of all cells that a polygon touches: those by centre and those its edges run through."""
    return _in_runs(_runs_touched(polygons, key, grid), key)


def later_wins(cells: DataFrame, key: str, order: str) -> DataFrame:
    """One zone per cell: where zones overlap, that with the last order."""
    return cells.groupBy("row", "col").agg(F.max_by(key, order).alias(key))


def cells_covered(polygons: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(row, col, key, coverage) of the cells that a polygon covers, wholly or in part: the exact share of the cell's area.

    An edge adds, in each row of cells it runs through, the signed area to the right of it: in part in the cells it
    crosses, in full in all cells after them. Sums along the row give the shares; cells between edges all have the same.
    """
    own = signed_edges(polygons, key)
    u, v = lambda x: (F.col(x) - grid.x0) / grid.dx, lambda y: (grid.y0 - F.col(y)) / grid.dy
    own = own.select(key, "sign", u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2")).where("v1 <> v2")
    own = own.withColumns({"r0": F.greatest(F.floor(F.least("v1", "v2")), F.lit(0)), "r1": F.least(F.floor(F.greatest("v1", "v2")), F.lit(grid.nrows - 1))}).where("r0 <= r1")
    own = own.withColumn("row", F.explode(F.sequence("r0", "r1")))
    clamp = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)
    va, vb = clamp(F.col("v1"), F.col("row"), F.col("row") + 1), clamp(F.col("v2"), F.col("row"), F.col("row") + 1)
    at = lambda w: F.col("u1") + (w - F.col("v1")) / (F.col("v2") - F.col("v1")) * (F.col("u2") - F.col("u1"))
    own = own.withColumns({"dv": (vb - va) * F.col("sign"), "ua": at(va), "ub": at(vb)}).where("dv <> 0")
    # what lies left of the grid counts from its first column on, what lies right of it for none
    column = lambda x: F.least(F.greatest(F.floor(x), F.lit(-1)), F.lit(grid.ncols))
    own = own.withColumn("col", F.explode(F.sequence(column(F.least("ua", "ub")), column(F.greatest("ua", "ub")))))
    low, high = F.when(F.col("col") < 0, F.lit(float("-inf"))).otherwise(F.col("col").cast("double")), F.when(F.col("col") >= grid.ncols, F.lit(float("inf"))).otherwise(F.col("col") + 1.0)
    uc, ud = clamp(F.col("ua"), low, high), clamp(F.col("ub"), low, high)
    share = F.when(F.col("ua") == F.col("ub"), 1.0).otherwise((ud - uc) / (F.col("ub") - F.col("ua")))
    own = own.withColumn("cover", F.col("dv") * share).withColumn("area", F.col("cover") * (1 - ((uc + ud) / 2 - F.col("col"))))
    parts = own.groupBy(key, "row", "col").agg(F.sum("cover").alias("cover"), F.sum("area").alias("area"))
    along = Window.partitionBy(key, "row").orderBy("col")
    parts = parts.withColumns({"before": F.coalesce(F.sum("cover").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "next": F.lead("col").over(along)})
    run = F.when(F.col("next") > F.col("col") + 1, F.transform(F.sequence(F.col("col") + 1, F.col("next") - 1), lambda c: F.struct(c.alias("col"), (F.col("before") + F.col("cover")).alias("coverage"))))
    mine = F.array(F.struct(F.col("col").alias("col"), (F.col("before") + F.col("area")).alias("coverage")))
    out = parts.select(key, "row", F.explode(F.concat(mine, F.coalesce(run, F.array().cast("array<struct<col:bigint,coverage:double>>")))).alias("c"))
    out = out.select(F.col("row").cast("int").alias("row"), F.col("c.col").cast("int").alias("col"), key, F.col("c.coverage").alias("coverage"))
    return out.where(F.col("col").between(0, grid.ncols - 1) & (F.col("coverage") > 1e-12))


def rasterise_mean(polygons: DataFrame, key: str, grid: Grid, values: list[str]) -> DataFrame:
    """Per cell the means of attributes over all polygons that touch it; runs of cells take the attributes, and the cells are summed as they come."""
    runs = _runs_touched(polygons, key, grid).join(polygons.select(key, *values).hint("merge"), key)
    return _in_runs(runs, *values).groupBy("row", "col").agg(*[F.avg(v).alias(v) for v in values])


def cells_in_circles(points: DataFrame, radius: float, grid: Grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """(row, col) of the cells whose centre is within the radius of any point; by keys such as the scenario."""
    cols = F.sequence(grid.col(F.col("x") - radius), grid.col(F.col("x") + radius))
    rows = F.sequence(grid.row(F.col("y") + radius), grid.row(F.col("y") - radius))
    near = points.select(*keys, "x", "y", F.explode(rows).alias("row"), cols.alias("cols")).withColumn("col", F.explode("cols"))
    away = F.pow(grid.x(F.col("col")) - F.col("x"), 2) + F.pow(grid.y(F.col("row")) - F.col("y"), 2)
    inside = F.col("row").between(0, grid.nrows - 1) & F.col("col").between(0, grid.ncols - 1)
    return near.where((away <= radius**2) & inside).select(*keys, F.col("row").cast("int"), F.col("col").cast("int")).distinct()


# ---- longitude and latitude to the national grid (published formulas)

#: Ellipsoids WGS 84 and Airy 1830, the datum shift between them, and the projection's constants.
WGS84, AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
SHIFT = {"tx": -446.448, "ty": 125.157, "tz": -542.060, "ppm": 20.4894, "rx": -0.1502, "ry": -0.2470, "rz": -0.8421}
SCALE, LAT0, LON0, NORTH0, EAST0 = 0.9996012717, 49.0, -2.0, -100000.0, 400000.0


def to_national_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; good to a few metres, as the datum shift is."""
    a, b = WGS84
    e2 = 1 - b * b / (a * a)
    phi, lam = F.radians(lat), F.radians(lon)
    nu = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    x, y, z = nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), (1 - e2) * nu * F.sin(phi)
    s = 1 + SHIFT["ppm"] * 1e-6
    rx, ry, rz = (radians(SHIFT[k] / 3600) for k in ("rx", "ry", "rz"))
    x, y, z = SHIFT["tx"] + s * x - rz * y + ry * z, SHIFT["ty"] + rz * x + s * y - rx * z, SHIFT["tz"] - ry * x + rx * y + s * z
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    phi = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
    lam = F.atan2(y, x)
    return _transverse_mercator(phi, lam, a, b, e2)


def _meridian(phi: Column, a: float, b: float) -> Column:
    """Arc of the meridian from the projection's latitude."""
    n, lat0 = (a - b) / (a + b), radians(LAT0)
    d, t = phi - lat0, phi + lat0
    return b * SCALE * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(t)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * t) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * t)
    )


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def from_national_grid(east: Column, north: Column) -> Column:
    """Longitude and latitude (a struct lon, lat) of easting and northing; the inverse of to_national_grid."""
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    # the footpoint latitude, by a fixed number of steps that each gain three digits
    foot = F.aggregate(F.sequence(F.lit(1), F.lit(8)), radians(LAT0) + (north - NORTH0) / (a * SCALE), lambda phi, _: phi + (north - NORTH0 - _meridian(phi, a, b)) / (a * SCALE))

    def lat_lon(phi: Column) -> Column:
        sin, tan, sec = F.sin(phi), F.tan(phi), 1 / F.cos(phi)
        nu = a * SCALE / F.sqrt(1 - e2 * sin * sin)
        rho = a * SCALE * (1 - e2) / F.pow(1 - e2 * sin * sin, F.lit(1.5))
        eta, t2, d = nu / rho - 1, tan * tan, east - EAST0
        lat = phi - tan / (2 * rho * nu) * d**2 + tan / (24 * rho * nu**3) * (5 + 3 * t2 + eta - 9 * t2 * eta) * d**4 - tan / (720 * rho * nu**5) * (61 + 90 * t2 + 45 * t2 * t2) * d**6
        lon = radians(LON0) + sec / nu * d - sec / (6 * nu**3) * (nu / rho + 2 * t2) * d**3 + sec / (120 * nu**5) * (5 + 28 * t2 + 24 * t2 * t2) * d**5
        return F.struct(lat.alias("phi"), lon.alias("lam"))

    def shifted(p: Column) -> Column:
        phi, lam = p["phi"], p["lam"]
        nu = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
        x, y, z = nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), (1 - e2) * nu * F.sin(phi)
        s = 1 - SHIFT["ppm"] * 1e-6
        rx, ry, rz = (-radians(SHIFT[k] / 3600) for k in ("rx", "ry", "rz"))
        return F.struct((-SHIFT["tx"] + s * x - rz * y + ry * z).alias("x"), (-SHIFT["ty"] + rz * x + s * y - rx * z).alias("y"), (-SHIFT["tz"] - ry * x + rx * y + s * z).alias("z"))

    def degrees(c: Column) -> Column:
        a, b = WGS84
        e2 = 1 - b * b / (a * a)
        p = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
        theta = F.atan2(c["z"] * a, p * b)
        phi = F.atan2(c["z"] + e2 / (1 - e2) * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
        return F.struct(F.degrees(F.atan2(c["y"], c["x"])).alias("lon"), F.degrees(phi).alias("lat"))

    return _bound(_bound(_bound(foot, lat_lon), shifted), degrees)


def _transverse_mercator(phi: Column, lam: Column, a: float, b: float, e2: float) -> tuple[Column, Column]:
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = a * SCALE / F.sqrt(1 - e2 * sin * sin)
    rho = a * SCALE * (1 - e2) / F.pow(1 - e2 * sin * sin, F.lit(1.5))
    eta = nu / rho - 1
    m = _meridian(phi, a, b)
    dl, t2 = lam - radians(LON0), tan * tan
    north = m + NORTH0 + nu / 2 * sin * cos * dl**2 + nu / 24 * sin * F.pow(cos, 3) * (5 - t2 + 9 * eta) * dl**4 + nu / 720 * sin * F.pow(cos, 5) * (61 - 58 * t2 + t2 * t2) * dl**6
    east = EAST0 + nu * cos * dl + nu / 6 * F.pow(cos, 3) * (nu / rho - t2) * dl**3 + nu / 120 * F.pow(cos, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) * dl**5
    return east, north
