"""Adaptive squares over polygons, so that points and polygons meet by equality.

A polygon starts from the four squares at most that its box touches, of a side of the power of two above the box; large
polygons have large squares. A square that more than `most_edges` edges run through is cut into four; one without an edge
is inside or goes. What is left grows with the outline: squares inside match without a test, those on the border carry
their own edges, and whether their centre is inside. A point crosses from the centre as often as those edges say.

Ties: the path between two centres, or from a centre to a point, runs upright just right of its x and level just above
its y, less right than above. So it meets no corner, and each edge is counted by one product alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.sources.sinks import parquet, scratch

MOST_EDGES, MAX_DEPTH = 16, 12
_NODE = ["level", "ix", "iy"]
_EDGE = ("x1", "y1", "x2", "y2")


def edges(features: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """A row per edge: key, x1, y1, x2, y2; rings need not repeat their first point."""
    ring = features.select(key, F.explode(rings).alias("r")).where(F.size("r") > 1)
    nxt = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", 1, 1))
    own = ring.select(key, F.explode(F.arrays_zip(F.col("r").alias("a"), nxt.alias("b"))).alias("e"))
    own = own.select(key, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return own.where("x1 <> x2 OR y1 <> y2")


# ---- an edge (columns or a struct) and a path


def _own() -> dict[str, Column]:
    return {c: F.col(c) for c in _EDGE}


def _side(e, a: Column, b: Column) -> Column:
    """Positive where (a, b) lies left of the edge from its first point to its second, 0 on its line."""
    return (e["x2"] - e["x1"]) * (b - e["y1"]) - (e["y2"] - e["y1"]) * (a - e["x1"])


def _right(e, a: Column, b: Column) -> Column:
    """The edge passes the height just above b right of a."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    side = _side(e, a, b)
    return (side * F.signum(dy) > 0) | ((side == 0) & (dx * dy > 0))


def _level(e, a: Column, b: Column, y: Column) -> Column:
    """A level leg at y from a to b crosses the edge."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (_right(e, a, y) != _right(e, b, y))


def _upright(e, x: Column, a: Column, b: Column) -> Column:
    """An upright leg at x from a to b crosses the edge."""
    above = lambda y: _side(e, x, y) * F.signum(e["x2"] - e["x1"]) < 0
    return ((e["x1"] > x) != (e["x2"] > x)) & (above(a) != above(b))


def on_edge(e, px: Column, py: Column) -> Column:
    return (_side(e, px, py) == 0) & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def _meets(e, cx: Column, cy: Column, half: Column) -> Column:
    """The edge touches a square, or all but does."""
    h = half * (1 + 1e-6)
    low, high = lambda a, b: F.least(e[a], e[b]), lambda a, b: F.greatest(e[a], e[b])
    near = (low("x1", "x2") <= cx + h) & (high("x1", "x2") >= cx - h) & (low("y1", "y2") <= cy + h) & (high("y1", "y2") >= cy - h)
    return near & (F.abs(_side(e, cx, cy)) <= h * (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])))


# ---- squares


def side_of(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def level_of(extent: Column) -> Column:
    """Of the smallest squares that are not smaller than a box."""
    return F.ceil(F.log2(extent)).cast("int")


def square(value: Column, level: Column) -> Column:
    return F.floor(value / side_of(level))


def boxes(edge_table: DataFrame, key: str, pad: float = 0.0) -> DataFrame:
    """(key, xmin, xmax, ymin, ymax, box_level) of polygons, widened by pad."""
    low = lambda a, b: F.min(F.least(a, b)) - pad
    high = lambda a, b: F.max(F.greatest(a, b)) + pad
    own = edge_table.groupBy(key).agg(low("x1", "x2").alias("xmin"), high("x1", "x2").alias("xmax"), low("y1", "y2").alias("ymin"), high("y1", "y2").alias("ymax"))
    return own.withColumn("box_level", level_of(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))))


def on_squares(own: DataFrame, level: Column, prefix: str = "") -> DataFrame:
    """A row for each square of a level that a box touches: level, ix, iy; four at most where the level is the box's own or above."""
    own = own.withColumn("level", level)
    span = lambda axis: F.explode(F.sequence(square(F.col(f"{prefix}{axis}min"), F.col("level")), square(F.col(f"{prefix}{axis}max"), F.col("level"))))
    return own.withColumn("ix", span("x")).withColumn("iy", span("y"))


def _centres(own: DataFrame) -> DataFrame:
    half = side_of(F.col("level")) / 2
    return own.withColumns({"half": half, "cx": (2 * F.col("ix") + 1) * half, "cy": (2 * F.col("iy") + 1) * half})


def quadtree(polygons: DataFrame, key: str, most_edges: int = MOST_EDGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, level, ix, iy, inside, edges): the squares of polygons (key, rings) that are inside or on the border.

    inside says so of the centre; edges are empty in squares inside. No square but those of the last depth has more than
    most_edges. A depth is one pass over the edges of the squares that have too many; without such polygons there is none.
    """
    own = edges(polygons, key)
    e = _own()
    roots = on_squares(boxes(own, key), F.col("box_level")).select(key, *_NODE)
    rows = _centres(own.join(roots, key))
    # the centre's: crossings on the way from far left
    rows = rows.withColumns({"meets": _meets(e, F.col("cx"), F.col("cy"), F.col("half")), "crosses": ((F.col("y1") > F.col("cy")) != (F.col("y2") > F.col("cy"))) & ~_right(e, F.col("cx"), F.col("cy")), "was": F.lit(False)})
    node = [key, *_NODE]
    inside = (F.max("was").cast("int") + F.count_if("crosses")) % 2 == 1
    edge = F.collect_list(F.when(F.col("meets"), F.struct(*_EDGE))).alias("edges")
    if own.groupBy(key).count().where(F.col("count") > most_edges).isEmpty():
        return rows.groupBy(*node).agg(inside.alias("inside"), edge).where("inside OR size(edges) > 0")
    out = None
    for depth in range(max_depth + 1):
        rows = parquet(rows.select(*node, *_EDGE, "meets", "crosses", "was", "cx", "cy"), f"{scratch(polygons.sparkSession)}/squares")
        state = rows.groupBy(*node).agg(inside.alias("inside"), F.count_if("meets").alias("n"))
        state = parquet(state.where("inside OR n > 0"), f"{scratch(polygons.sparkSession)}/squares")
        over = (F.col("n") > most_edges) & F.lit(depth < max_depth)
        few = rows.where("meets").join(state.where(~over & (F.col("n") > 0)), node).groupBy(*node, "inside").agg(F.collect_list(F.struct(*_EDGE)).alias("edges"))
        none = state.where("n = 0").select(*node, "inside", F.array().cast(few.schema["edges"].dataType).alias("edges"))
        out = few.unionByName(none) if out is None else out.unionByName(few).unionByName(none)
        over_state = state.where(over)
        if over_state.isEmpty():
            break
        rows = rows.where("meets").join(over_state.select(*node, "inside"), node).withColumnsRenamed({"cx": "px", "cy": "py"})
        quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        rows = rows.withColumn("q", quarter).withColumns({"level": F.col("level") - 1, "ix": 2 * F.col("ix") + F.col("q.i"), "iy": 2 * F.col("iy") + F.col("q.j")})
        rows = _centres(rows)
        # from the old centre upright, then level; a leg that turns back is none
        crossed = _upright(e, F.col("px"), F.col("py"), F.col("cy")) != _level(e, F.col("px"), F.col("cx"), F.col("cy"))
        rows = rows.withColumns({"meets": _meets(e, F.col("cx"), F.col("cy"), F.col("half")), "crosses": crossed, "was": F.col("inside")})
    return out


def matches(points: DataFrame, index: DataFrame, key: str, covers: bool, within: str | None = None) -> DataFrame:
    """The rows of points (columns px, py) for each polygon of an index that has them; points on an edge count only with covers.

    A point looks up one square of each size that the index has, by equality; within names a column of both that has to
    be equal too.
    """
    levels = index.select("level").distinct()  # sizes: as many as there are powers of two between the squares' sides
    own = points.where("px IS NOT NULL AND py IS NOT NULL").crossJoin(F.broadcast(levels))
    own = own.withColumns({"ix": square(F.col("px"), F.col("level")), "iy": square(F.col("py"), F.col("level"))})
    met = _centres(own.join(index, [*_NODE, *([within] if within else [])]))
    px, py, cx, cy = (F.col(c) for c in ("px", "py", "cx", "cy"))
    crossings = F.size(F.filter("edges", lambda e: _level(e, cx, px, cy) != _upright(e, px, cy, py)))
    odd = (F.col("inside").cast("int") + crossings) % 2 == 1
    touches = F.exists("edges", lambda e: on_edge(e, px, py))
    return met.where(odd & ~touches if not covers else odd | touches).select(*points.columns, key)


# ---- boxes that meet


def near_points(points: DataFrame, own_boxes: DataFrame) -> DataFrame:
    """Points (px, py) with each box that has them, a row a pair."""
    levels = own_boxes.select(F.col("box_level").alias("level")).distinct()
    own = points.where("px IS NOT NULL AND py IS NOT NULL").crossJoin(F.broadcast(levels))
    own = own.withColumns({"ix": square(F.col("px"), F.col("level")), "iy": square(F.col("py"), F.col("level"))})
    inside = F.col("px").between(F.col("xmin"), F.col("xmax")) & F.col("py").between(F.col("ymin"), F.col("ymax"))
    return own.join(on_squares(own_boxes, F.col("box_level")), _NODE).where(inside).drop(*_NODE, "box_level")


def meeting_boxes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes of two tables (columns with the prefixes a and b) that meet, once each.

    The larger box of a pair stands in its own squares, the smaller one is looked up in squares of that size.
    """

    def looked_up(small: DataFrame, large: DataFrame, s: str, g: str, ties: bool) -> DataFrame:
        levels = large.select(F.col(f"{g}box_level").alias("__level")).distinct()
        own = small.crossJoin(F.broadcast(levels)).where(F.col("__level") >= F.col(f"{s}box_level") if ties else F.col("__level") > F.col(f"{s}box_level"))
        own = on_squares(own, F.col("__level"), s).drop("__level")
        return own.join(on_squares(large, F.col(f"{g}box_level"), g), _NODE)

    both = looked_up(a, b, "a", "b", True).unionByName(looked_up(b, a, "b", "a", False))
    meet = (F.col("axmin") <= F.col("bxmax")) & (F.col("bxmin") <= F.col("axmax")) & (F.col("aymin") <= F.col("bymax")) & (F.col("bymin") <= F.col("aymax"))
    first = (F.col("ix") == square(F.greatest("axmin", "bxmin"), F.col("level"))) & (F.col("iy") == square(F.greatest("aymin", "bymin"), F.col("level")))
    return both.where(meet & first).drop(*_NODE)
