"""Registered queries of the library's operators over the driver's tables, each with its SQL for the oracle where SQL has one."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from heatgrid.functions import classify, climate, dates, text
from heatgrid.functions import health as H
from heatgrid.operators import geometry, grid, health, landcover, observations, profile, scenario, stats, tiles, trees, vulnerability, zonal
from heatgrid.operators.grid import Grid
from heatgrid.plans import bridges as B
from heatgrid.plans.registry import QUERIES, SQL, query, rounded  # noqa: F401
from heatgrid.sources import readers
from heatgrid.sources.sinks import scratch


def _causes_sql() -> str:
    rows = ", ".join(f"('{n}', ln({rr}::DOUBLE), (ln({hi}::DOUBLE) - ln({lo}::DOUBLE)) / 3.92)" for n, rr, lo, hi in H.CAUSES)
    return f"causes(cause, beta, se) AS (VALUES {rows})"


def _labels_sql() -> str:
    return "labels(code, label) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in classify.LAND_COVER.items()) + ")"


def _draws_sql() -> str:
    z = ", ".join(f"({i}, {q}::DOUBLE)" for i, q in enumerate(B.QUANTILES, 1))
    return f"z(draw, q) AS (VALUES {z}), draws AS (SELECT cause, draw, beta + q * se AS beta FROM causes, z), totals AS (SELECT cause, draw, coalesce(sum(deaths / nullif(pop0, 0) * pop1 * (1 - exp(-beta * (t1 - t0)))), 0) AS excess FROM cells, draws GROUP BY 1, 2)"


CAUSES, LABELS, DRAWS = _causes_sql(), _labels_sql(), _draws_sql()


def _case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


# ---- health


@query(f"""WITH {B.CELLS}, {CAUSES}, x AS (SELECT cause, deaths / nullif(pop0, 0) * pop1 AS adjusted, 1 - exp(-beta * (t1 - t0)) AS af FROM cells, causes),
t AS (SELECT cause, coalesce(sum(adjusted), 0) AS deaths, coalesce(sum(adjusted * af), 0) AS excess FROM x GROUP BY 1)
SELECT cause, round(deaths, 6) AS deaths, round(excess, 6) AS excess, round(CASE WHEN deaths + excess > 0 THEN excess / (deaths + excess) ELSE 0 END, 6) AS share FROM t""")
def city_excess_deaths(spark, d):
    return rounded(health.city_totals(health.with_excess(B.cells(spark, d), health.causes(spark))))


@query(f"""WITH {B.CELLS}, {CAUSES}, {DRAWS} SELECT cause, round(quantile_cont(excess, 0.025), 6) AS p2_5, round(quantile_cont(excess, 0.5), 6) AS p50, round(quantile_cont(excess, 0.975), 6) AS p97_5,
round(avg(excess), 6) AS mean, round(stddev_pop(excess), 6) AS sd, round(min(excess), 6) AS least, round(max(excess), 6) AS largest FROM totals GROUP BY 1""")
def monte_carlo_summary(spark, d):
    return rounded(health.draw_summary(health.draw_totals(B.cells(spark, d), health.normal_draws(health.causes(spark), B.QUANTILES))))


@query(f"WITH {B.CELLS}, {CAUSES}, {DRAWS} SELECT draw, " + ", ".join(f"round(max(excess) FILTER (cause = '{c[0]}'), 6) AS {c[0]}" for c in H.CAUSES) + " FROM totals GROUP BY 1")
def draw_matrix_wide(spark, d):
    totals = health.draw_totals(B.cells(spark, d), health.normal_draws(health.causes(spark), B.QUANTILES))
    return rounded(health.draw_matrix(totals, [c[0] for c in H.CAUSES]))


@query(f"""WITH {B.CELLS}, {CAUSES} SELECT "row", col, cause, round(CASE WHEN pop0 > 0 THEN deaths / pop0 * pop1 END, 12) AS adjusted, round(1 - exp(-beta * (t1 - t0)), 9) AS af,
round(CASE WHEN pop0 > 0 THEN deaths / pop0 * pop1 END * (1 - exp(-beta * (t1 - t0))), 9) AS excess FROM cells, causes""")
def health_layers(spark, d):
    own = health.with_excess(B.cells(spark, d), health.causes(spark))
    return own.select("row", "col", "cause", F.round("adjusted", 12).alias("adjusted"), F.round("af", 9).alias("af"), F.round("excess", 9).alias("excess"))


@query(f"""WITH {B.CELLS}, x AS (SELECT CASE WHEN abs(t1 - t0) <= 1.6 THEN t1 - t0 END AS v FROM cells) SELECT count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS largest,
count(*) FILTER (v > 0) AS n_positive, """ + ", ".join(f"round(quantile_cont(v, {p}), 6) AS {k}" for k, p in {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}.items()) + " FROM x")
def delta_t_profile(spark, d):
    return rounded(grid.profile(health.delta_t(B.cells(spark, d), 1.6), "delta"))


@query("""WITH c AS (SELECT unnest(['20_2', '22_2', '25_5', '28_5']) AS climate_case, unnest([26.0, 28.5, 31.0, 34.0]) AS base), o AS (SELECT o_orderstatus AS scenario, o_totalprice / 100000 AS x FROM orders)
SELECT climate_case, scenario, count(*) AS n, round(avg(0.1 + 0.9 / (1 + pow((base::DOUBLE + x) / 30.94, 16.64))), 6) AS workability, round(min(base::DOUBLE + x), 6) AS wbgt_min FROM o, c GROUP BY 1, 2""")
def workability_by_case(spark, d):
    cases = spark.createDataFrame([("20_2", 26.0), ("22_2", 28.5), ("25_5", 31.0), ("28_5", 34.0)], "climate_case string, base double")
    own = B.table(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario"), (F.col("o_totalprice") / 100000).alias("x")).crossJoin(F.broadcast(cases))
    own = own.withColumn("wbgt", F.col("base") + F.col("x")).withColumn("w", climate.workability(F.col("wbgt")))
    return rounded(own.groupBy("climate_case", "scenario").agg(F.count("*").alias("n"), F.avg("w").alias("workability"), F.min("wbgt").alias("wbgt_min")))


@query("""WITH x AS (SELECT o_orderpriority AS layer, o_totalprice / 20000 + 275.0::DOUBLE AS k FROM orders), y AS (SELECT layer, k - 273.15 AS t, k - 273.15 - 3 AS d FROM x),
m AS (SELECT layer, t, 0.6112 * exp(17.67 * t / (t + 243.5)) AS es, 0.6112 * exp(17.67 * d / (d + 243.5)) AS e FROM y)
SELECT layer, round(min(e), 6) AS least, round(avg(e), 6) AS mean, round(max(e), 6) AS largest, round(avg(100 * e / es), 6) AS rh, round(avg(es - e), 6) AS vpd FROM m GROUP BY 1""")
def humidity_layers(spark, d):
    t = climate.kelvin_to_celsius(F.col("o_totalprice") / 20000 + 275.0)
    own = B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("layer"), t.alias("t"), (t - 3).alias("d"))
    own = own.withColumns({"value": climate.magnus_kpa(F.col("d")), "rh": climate.relative_humidity(F.col("t"), F.col("d")), "vpd": climate.vapour_pressure_deficit(F.col("t"), F.col("d"))})
    rest = own.groupBy("layer").agg(F.avg("rh").alias("rh"), F.avg("vpd").alias("vpd"))
    return rounded(grid.layer_extremes(own).join(rest, "layer"))


@query("""SELECT n_nationkey AS area, round(sum(CASE WHEN n_nationkey > 0 THEN c_acctbal / (n_nationkey * 10000) * 100 END), 6) AS deaths FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def deaths_per_cell(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("area"), H.deaths_per_cell(F.col("c_acctbal"), F.col("c_nationkey"), 10.0).alias("v"))
    return rounded(c.groupBy("area").agg(F.sum("v").alias("deaths")))


# ---- land cover

_SUMMARY = """SELECT code, coalesce(label, 'Unknown (' || code || ')') AS label, cells, round(cells / total, 6) AS share, round(cells / total * 100, 3) AS pct, cells * 100.0::DOUBLE AS m2, round(cells * 100.0::DOUBLE / 1e4, 2) AS ha, round(cells * 100.0::DOUBLE / 1e6, 2) AS km2
FROM (SELECT lc0 AS code, count(*) AS cells, sum(count(*)) OVER ()::DOUBLE AS total FROM cells WHERE lc0 <> 0 GROUP BY 1) LEFT JOIN labels USING (code)"""


@query(f"WITH {B.CELLS}, {LABELS} {_SUMMARY}")
def lc_class_summary(spark, d):
    return landcover.class_summary(B.cells(spark, d), "lc0", landcover.classes(spark))


@query(f"""WITH {B.CELLS}, {LABELS}, a AS (SELECT l.code, l.label, coalesce(n, 0) AS cells FROM labels l LEFT JOIN (SELECT lc1 AS code, count(*) AS n FROM cells WHERE lc1 <> 0 GROUP BY 1) c USING (code)),
b AS (SELECT code, label, cells, round(cells * 100.0::DOUBLE / 1e6, 4) AS km2, round(cells * 100 / sum(cells) OVER ()::DOUBLE, 4) AS pct FROM a)
SELECT * FROM b UNION ALL SELECT NULL, 'Total', sum(cells)::BIGINT, round(sum(km2), 4), round(sum(pct), 1) FROM b""")
def lc_class_stats_full(spark, d):
    return landcover.with_total(landcover.class_areas(B.cells(spark, d), "lc1", landcover.classes(spark)))


@query(f"""WITH {B.CELLS}, {LABELS}, n AS (SELECT lc0 AS from_code, lc1 AS to_code, count(*) AS cells FROM cells GROUP BY 1, 2)
SELECT from_code, to_code, cells, coalesce(a.label, 'Unknown (' || from_code || ')') AS from_label, coalesce(b.label, 'Unknown (' || to_code || ')') AS to_label, from_code * 1000 + to_code AS code,
CASE WHEN from_code = to_code THEN 'Stable' ELSE 'Change' END AS status, cells * 100.0::DOUBLE AS m2, cells * 100.0::DOUBLE / 1e6 AS km2 FROM n LEFT JOIN labels a ON a.code = from_code LEFT JOIN labels b ON b.code = to_code""")
def lc_transition_matrix(spark, d):
    return landcover.transitions(B.cells(spark, d), "lc0", "lc1", landcover.classes(spark))


@query(f"""WITH {B.CELLS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN lc0 IN (0, 255) OR lc1 IN (0, 255) THEN NULL WHEN lc0 = lc1 THEN 'stable' WHEN lc1 = 100 THEN 'target' ELSE 'changed' END AS status FROM cells) GROUP BY 1""")
def lc_change_mask(spark, d):
    return B.cells(spark, d).groupBy(classify.change_status(F.col("lc0") * 1000 + F.col("lc1"), 100).alias("status")).agg(F.count("*").alias("n"))


_RECODED = """SELECT lc0, new, count(*) AS n FROM (SELECT lc0, {} AS new FROM cells) GROUP BY 1, 2"""


def _recoded(spark, d, new):
    return B.cells(spark, d).groupBy("lc0", new.alias("new")).agg(F.count("*").alias("n"))


@query(f"WITH {B.CELLS} " + _RECODED.format("CASE WHEN lc0 IN (1, 2, 4, 5, 6, 7, 9, 10, 100) THEN 20 ELSE lc0 END"))
def lc_paving(spark, d):
    return _recoded(spark, d, landcover.pave(F.col("lc0")))


@query(f"WITH {B.CELLS} " + _RECODED.format("CASE WHEN lc0 IN (1, 2, 100) AND risk_year = 2050 THEN 4 ELSE lc0 END"))
def lc_tree_risk(spark, d):
    return _recoded(spark, d, landcover.tree_risk(F.col("lc0"), F.col("risk_year")))


@query(f"WITH {B.CELLS} " + _RECODED.format("CASE WHEN lc0 IN (5, 6) THEN CASE WHEN canopy <= 7 THEN lc0 * 10 + 1 WHEN canopy <= 20 THEN lc0 * 10 + 2 WHEN canopy > 20 THEN lc0 * 10 + 3 ELSE 0 END ELSE lc0 * 10 END"))
def lc_canopy_reclass(spark, d):
    return _recoded(spark, d, landcover.canopy_reclass(F.col("lc0"), F.col("canopy")))


@query(f"""WITH {B.CELLS}, b AS (SELECT lc0 AS code, count(*) AS n FROM cells WHERE lc0 <> 0 GROUP BY 1), a AS (SELECT lc1 AS code, count(*) AS n FROM cells WHERE lc1 <> 0 GROUP BY 1),
x AS (SELECT code, coalesce(b.n, 0) AS cells_before, coalesce(round(b.n * 100.0::DOUBLE / 1e4, 2), 0) AS ha_before, coalesce(a.n, 0) AS cells_after, coalesce(round(a.n * 100.0::DOUBLE / 1e4, 2), 0) AS ha_after FROM b FULL JOIN a USING (code))
SELECT *, cells_after - cells_before AS cells_change, round(ha_after - ha_before, 2) AS ha_change FROM x""")
def lc_area_change(spark, d):
    c, labels = B.cells(spark, d), landcover.classes(spark)
    return landcover.area_change(landcover.class_summary(c, "lc0", labels), landcover.class_summary(c, "lc1", labels))


@query(f"WITH {B.CELLS} SELECT count(*) FILTER (lc0 <> lc1) AS cells, count(*) FILTER (lc0 <> lc1) * 100.0::DOUBLE AS m2 FROM cells")
def lc_changed_cells(spark, d):
    return landcover.changed_cells(B.cells(spark, d), "lc0", "lc1")


@query(f"""WITH {B.CELLS}, {B.TREES}, s(scenario, n_trees) AS (VALUES ('low', 50), ('mid', 400), ('high', 900)), r AS (SELECT *, row_number() OVER (ORDER BY rank, id) AS place FROM trees),
p AS (SELECT scenario, x, y FROM r JOIN s ON place <= n_trees), c AS (SELECT DISTINCT scenario, "row", col FROM p JOIN cells ON pow(col + 0.5 - x, 2) + pow(-("row" + 0.5::DOUBLE) - y, 2) <= 2.25)
SELECT scenario, new, count(*) AS n FROM (SELECT s.scenario, CASE WHEN c.scenario IS NOT NULL AND lc0 <> 0 THEN 100 ELSE lc0 END AS new FROM cells JOIN s ON true LEFT JOIN c ON c.scenario = s.scenario AND c."row" = cells."row" AND c.col = cells.col) GROUP BY 1, 2""")
def burn_top_n_trees(spark, d):
    names = spark.createDataFrame([("low", 50), ("mid", 400), ("high", 900)], "scenario string, n_trees int")
    top = landcover.top_ranked(B.trees(spark, d), names)
    covered = geometry.cells_in_circles(top, 1.5, B.GRID, ("scenario",)).withColumn("covered", F.lit(True))
    base = B.cells(spark, d).select("row", "col", "lc0").crossJoin(F.broadcast(names.select("scenario")))
    burnt = base.join(covered, ["scenario", "row", "col"], "left").select("scenario", landcover.burn_in(F.col("lc0"), F.col("covered")).alias("new"))
    return burnt.groupBy("scenario", "new").agg(F.count("*").alias("n"))


# ---- grids


COARSE = Grid(-0.5, 0.25, 2.5, 2.5, 10**9, 41)


@query(f"""WITH {B.CELLS}, s AS (SELECT col::DOUBLE AS l, col + 1.0::DOUBLE AS r, -"row"::DOUBLE AS t, -("row" + 1.0::DOUBLE) AS b, pop0 AS v FROM cells),
x AS (SELECT *, unnest(range(floor((l + 0.5) / 2.5)::BIGINT, ceil((r + 0.5) / 2.5)::BIGINT)) AS col FROM s), y AS (SELECT *, unnest(range(floor((0.25 - t) / 2.5)::BIGINT, ceil((0.25 - b) / 2.5)::BIGINT)) AS "row" FROM x)
SELECT "row", col, round(sum(v * greatest(least(r, -0.5 + (col + 1) * 2.5) - greatest(l, -0.5 + col * 2.5), 0) * greatest(least(t, 0.25 - "row" * 2.5) - greatest(b, 0.25 - ("row" + 1) * 2.5), 0)), 6) AS value FROM y GROUP BY 1, 2""")
def count_preserving_resample(spark, d):
    return rounded(grid.resample_counts(B.cells(spark, d).select("row", "col", F.col("pop0").alias("value")), B.GRID, COARSE))


@query(f"WITH {B.CELLS} SELECT round(sum(pop0), 4) AS before, round(sum(pop0), 4) AS after, 1.0::DOUBLE AS ratio FROM cells")
def resample_preservation(spark, d):
    own = B.cells(spark, d).select("row", "col", F.col("pop0").alias("value"))
    return rounded(grid.preservation(own, grid.resample_counts(own, B.GRID, COARSE)), 4)


FINE = Grid(0.2, -0.1, 0.8, 0.8, 10**9, 120)
_TARGETS = '''targets AS (SELECT "row", col, 0.2 + (col + 0.5::DOUBLE) * 0.8 AS x, -0.1 - ("row" + 0.5::DOUBLE) * 0.8 AS y FROM cells)'''


@query(f"""WITH {B.CELLS}, {_TARGETS} SELECT t."row", t.col, c.t0 AS value FROM targets t LEFT JOIN cells c ON c."row" = floor(-t.y) AND c.col = floor(t.x)""")
def nearest_align(spark, d):
    own = B.cells(spark, d)
    return grid.nearest(own.select("row", "col", F.col("t0").alias("value")), B.GRID, FINE, own.select("row", "col"))


@query(f"""WITH {B.CELLS}, {_TARGETS}, f AS (SELECT "row", col, x - 0.5 AS fx, -y - 0.5 AS fy FROM targets),
n AS (SELECT "row", col, floor(fy) + dr AS r, floor(fx) + dc AS c, (CASE dr WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE dc WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM f, range(2) a(dr), range(2) b(dc))
SELECT n."row", n.col, round(sum(w * t1) / sum(w), 10) AS value FROM n JOIN cells c ON c."row" = r AND c.col = c WHERE w > 0 AND t1 IS NOT NULL GROUP BY 1, 2""".replace("floor(fx) + dc AS c,", "floor(fx) + dc AS cc,").replace("c.col = c WHERE", "c.col = cc WHERE"))
def bilinear_align(spark, d):
    own = B.cells(spark, d)
    return rounded(grid.bilinear(own.select("row", "col", F.col("t1").alias("value")), B.GRID, FINE, own.select("row", "col")), 10)


# ---- grids in tiles: the same results as cell by cell

TILE = 64


@query(SQL["bilinear_align"])
def bilinear_tiles(spark, d):
    own = B.cells(spark, d)
    fine = tiles.resample(tiles.to_tiles(own.select("row", "col", F.col("t1").alias("value")), ["value"], TILE), "value", B.GRID, FINE, "bilinear", TILE)
    wanted = tiles.aligned(fine, tiles.to_tiles(own, ["t0"], TILE), FINE, FINE)  # the cells that are asked for
    kept = tiles.algebra(wanted, ["value", "t0"], lambda x: {"value": np.where(np.isnan(x["t0"]), np.nan, x["value"])}, ["value"], TILE)
    return rounded(tiles.to_cells(kept, ["value"], TILE), 10)


@query(SQL["count_preserving_resample"])
def count_preserving_tiles(spark, d):
    own = tiles.to_tiles(B.cells(spark, d).select("row", "col", F.col("pop0").alias("value")), ["value"], TILE)
    return rounded(tiles.to_cells(tiles.resample_counts(own, "value", B.GRID, COARSE, TILE), ["value"], TILE))


@query(f"""WITH {B.CELLS}, {B.POINTS}, m AS (SELECT p.id, count(t1) AS n, sum(round(t1 * 1e7)) AS s FROM points p JOIN cells c ON c."row" BETWEEN floor(-p.y - 6) AND floor(-p.y + 6) AND c.col BETWEEN floor(p.x - 6) AND floor(p.x + 6)
WHERE pow(c.col + 0.5::DOUBLE - p.x, 2) + pow(-(c."row" + 0.5::DOUBLE) - p.y, 2) <= 25 GROUP BY 1)
SELECT p.id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN s END AS sum, CASE WHEN n > 0 THEN s / n END AS mean FROM points p LEFT JOIN m USING (id)""")
def disc_means(spark, d):
    """Temperature, in whole ten millionths so that sums are exact, within 5 cells of each point."""
    own = tiles.to_tiles(B.cells(spark, d).select("row", "col", F.round(F.col("t1") * 1e7).alias("t1")), ["t1"], TILE)
    return tiles.disc_sums(B.points(spark, d), own, "t1", "id", 5.0, B.GRID, TILE)


@query("""WITH g AS (SELECT o_orderstatus AS layer, max(o_orderkey // 100)::INT - min(o_orderkey // 100)::INT + 1 AS nrows, max(o_orderkey % 100)::INT + 1 AS ncols FROM orders GROUP BY 1)
SELECT layer, nrows, ncols, nrows::BIGINT * ncols AS n_cells FROM g ORDER BY n_cells DESC, layer LIMIT 1""")
def reference_grid(spark, d):
    row, col = F.floor(F.col("o_orderkey") / 100), F.col("o_orderkey") % 100
    own = B.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("layer")).agg((F.max(row) - F.min(row) + 1).cast("int").alias("nrows"), (F.max(col) + 1).cast("int").alias("ncols"))
    return grid.choose_reference(own)


@query(f"""WITH {B.CELLS}, {B.ZONES} SELECT c."row", c.col, CASE WHEN z.zone IS NOT NULL THEN lc0 ELSE 0 END AS value FROM cells c LEFT JOIN (SELECT * FROM zone_cells WHERE zone = 7) z ON z."row" = c."row" AND z.col = c.col
WHERE c."row" BETWEEN (SELECT min("row") FROM zone_cells WHERE zone = 7) AND (SELECT max("row") FROM zone_cells WHERE zone = 7) AND c.col BETWEEN (SELECT min(col) FROM zone_cells WHERE zone = 7) AND (SELECT max(col) FROM zone_cells WHERE zone = 7)""")
def clip_to_zone(spark, d):
    own = B.cells(spark, d).select("row", "col", F.col("lc0").alias("value"))
    covered = geometry.cells_by_centre(B.zones(spark, d).where("zone = 7"), "zone", B.GRID).join(own.select("row", "col"), ["row", "col"])
    return grid.clip(own, covered)


@query(f"""WITH {B.CELLS} SELECT "row", col, lc0 FROM cells WHERE col + 0.5 BETWEEN 45 AND 55 AND -("row" + 0.5) BETWEEN -13 AND -3""")
def zoom_window(spark, d):
    return grid.zoom_window(B.cells(spark, d), B.GRID, 50.0, -8.0, 10.0).select("row", "col", "lc0")


@query("""WITH x AS (SELECT floor(((c_custkey * 37 % 1000) / 10 + 0.03::DOUBLE) / 10)::BIGINT AS i, floor((-((c_custkey * 91 % 1000) / 10 + 0.07::DOUBLE)) / 10)::BIGINT AS j, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 4 + 2050 END AS year FROM customer),
v AS (SELECT i, j, year, count(*) AS n FROM x GROUP BY 1, 2, 3), b AS (SELECT i, j, year, row_number() OVER (PARTITION BY i, j ORDER BY year IS NULL, n DESC, year) AS k, sum(n) OVER (PARTITION BY i, j)::BIGINT AS points FROM v)
SELECT i, j, points, year, i * 10.0::DOUBLE AS xmin, j * 10.0::DOUBLE AS ymin, i * 10.0::DOUBLE + 10 AS xmax, j * 10.0::DOUBLE + 10 AS ymax FROM b WHERE k = 1""")
def lattice_majority(spark, d):
    own = B.points(spark, d).withColumn("year", F.when(F.col("id") % 6 != 0, F.col("id") % 4 + 2050))
    return grid.with_corners(grid.majority(grid.lattice(own, 0.0, 0.0), "year"), 0.0, 0.0)


@query("""WITH t AS (SELECT o_orderstatus AS tile, (o_orderkey // 100 % 40)::INT AS "row", (o_orderkey % 100)::INT AS col, avg(o_totalprice / 1000) AS value FROM orders GROUP BY 1, 2, 3)
SELECT "row", col, round(arg_max(value, tile), 10) AS value FROM t GROUP BY 1, 2""")
def scene_mosaic(spark, d):
    k = F.col("o_orderkey")
    own = B.table(spark, d, "orders").select(F.col("o_orderstatus").alias("tile"), (F.floor(k / 100) % 40).cast("int").alias("row"), (k % 100).cast("int").alias("col"), (F.col("o_totalprice") / 1000).alias("value"))
    return rounded(grid.mosaic(grid.scene_mean(own)), 10)


@query(f"""WITH {B.CELLS}, x AS (SELECT min(t1 - t0) AS lo, max(t1 - t0) AS hi FROM cells) SELECT round(-greatest(abs(lo), abs(hi)) * 1.1, 6) AS low, round(greatest(abs(lo), abs(hi)) * 1.1, 6) AS high FROM x""")
def colour_limits(spark, d):
    return rounded(grid.colour_limits(health.delta_t(B.cells(spark, d)), "delta", 0.1))


# ---- zones

_ZONAL = f"WITH {B.CELLS}, {B.ZONES} "


@query(_ZONAL + """SELECT zone, count(t1) AS n, round(avg(t1), 9) AS mean, round(sum(t1), 4) AS sum FROM cells JOIN zone_cells USING ("row", col) GROUP BY 1""")
def zonal_temperature(spark, d):
    own = geometry.cells_by_centre(B.zones(spark, d), "zone", B.GRID)
    return zonal.zonal(B.cells(spark, d), own, "zone", "t1").select("zone", "n", F.round("mean", 9).alias("mean"), F.round("sum", 4).alias("sum"))


@query(_ZONAL + """SELECT region, count(deaths) AS n, round(avg(deaths), 9) AS mean, round(sum(deaths), 5) AS sum FROM cells JOIN zone_cells USING ("row", col) JOIN corners USING (zone) GROUP BY 1""")
def zonal_deaths_by_region(spark, d):
    z = B.zones(spark, d)
    own = geometry.cells_by_centre(z, "zone", B.GRID).join(F.broadcast(z.select("zone", "region")), "zone")
    return zonal.zonal(B.cells(spark, d), own.drop("zone"), "region", "deaths").select("region", "n", F.round("mean", 9).alias("mean"), F.round("sum", 5).alias("sum"))


@query(_ZONAL + """, area AS (SELECT zone, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY 1)
SELECT zone, count(*) FILTER (lc1 = 100) AS tree_cells, round(count(*) FILTER (lc1 = 100) * 1.0::DOUBLE / any_value(area) * 100, 6) AS tree_pct FROM area LEFT JOIN zone_cells USING (zone) LEFT JOIN cells USING ("row", col) GROUP BY 1""")
def tree_cover_pct(spark, d):
    z = B.zones(spark, d)
    areas = geometry.polygon_areas(z, "zone").withColumnRenamed("m2", "area")
    own = geometry.cells_by_centre(z, "zone", B.GRID)
    return rounded(zonal.tree_cover(own, B.cells(spark, d).where("lc1 = 100"), areas, "zone", 1.0))


@query(f"WITH {B.CELLS}, {B.ZONES}, {B.POINTS} SELECT c.zone, p.id FROM corners c LEFT JOIN point_zones p USING (zone)")
def points_in_zones_left(spark, d):
    return geometry.polygons_with_points(B.zones(spark, d), B.points(spark, d), "zone", "id")


@query(f"WITH {B.CELLS}, {B.ZONES}, {B.POINTS} SELECT c.zone, count(p.id) AS n, round(coalesce(sum(value), 0), 5) AS sum, round(coalesce(avg(value), 0), 9) AS mean FROM corners c LEFT JOIN point_zones USING (zone) LEFT JOIN points p USING (id) GROUP BY 1")
def building_zonal(spark, d):
    return zonal.by_centroid(B.zones(spark, d), B.points(spark, d), "zone", "id", "value").select("zone", "n", F.round("sum", 5).alias("sum"), F.round("mean", 9).alias("mean"))


@query(f"""WITH {B.CELLS}, {B.ZONES}, {B.POINTS}, m AS (SELECT zone, id, nullif(trim(use), '') AS use FROM point_zones JOIN points USING (id)), v AS (SELECT zone, use, count(*) AS n FROM m WHERE use IS NOT NULL GROUP BY 1, 2)
SELECT zone, count(id) AS point_count, (SELECT use FROM v WHERE v.zone = m.zone ORDER BY n DESC, use LIMIT 1) AS use_mode, '["' || array_to_string(list_sort(list(DISTINCT use) FILTER (use IS NOT NULL)), '","') || '"]' AS use_unique FROM m GROUP BY 1""")
def point_attributes(spark, d):
    p = B.points(spark, d)
    own = geometry.points_in_polygons(p, B.zones(spark, d), "id", "zone").join(p, "id")
    return zonal.point_attributes(own, "zone", "id", ["use"])


@query(f"""WITH {B.CELLS}, {B.ZONES}, {B.POINTS}, q AS (SELECT id, x, y FROM points), s AS (SELECT q.id, e.zone, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t, * EXCLUDE (id, zone) FROM q JOIN edges e ON true),
w AS (SELECT zone, id, min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) AS outline, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) AS n FROM s GROUP BY 1, 2),
k AS (SELECT zone, id, CASE WHEN n % 2 = 1 THEN 0 ELSE outline END AS distance FROM w), f AS (SELECT zone, id, distance, rank() OVER (PARTITION BY zone ORDER BY distance) AS r FROM k WHERE distance <= 5)
SELECT zone, id, round(distance, 6) AS distance, round(distance * 100)::INT AS cm FROM f WHERE r = 1""")
def nearest_points(spark, d):
    return _nearest_points(B.points(spark, d), B.zones(spark, d))


def _nearest_points(p, z):
    own = geometry.nearest_within(p, z, "id", "zone", 5.0)
    return own.select("zone", "id", F.round("distance", 6).alias("distance"), classify.centimetres(F.col("distance")).alias("cm"))


@query(f"""WITH {B.CELLS}, {B.ZONES}, {B.POINTS}, p AS (SELECT zone, count(*) AS n, min(id) AS first FROM point_zones GROUP BY 1), q AS (SELECT id, x, y FROM points),
s AS (SELECT q.id, e.zone, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t, * EXCLUDE (id, zone) FROM q JOIN edges e ON true),
w AS (SELECT zone, id, min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) AS outline, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) AS k FROM s GROUP BY 1, 2),
z AS (SELECT zone, id, CASE WHEN k % 2 = 1 THEN 0 ELSE outline END AS distance FROM w), f AS (SELECT zone, count(*) AS n, min(id) AS first FROM (SELECT *, rank() OVER (PARTITION BY zone ORDER BY distance) AS r FROM z WHERE distance <= 5) WHERE r = 1 GROUP BY 1)
SELECT c.zone, CASE WHEN p.n IS NULL AND f.n > 0 THEN f.n ELSE p.n END AS n, CASE WHEN p.n IS NULL AND f.n > 0 THEN f.first ELSE p.first END AS first, CASE WHEN p.n IS NULL AND f.n > 0 THEN 'nearest' WHEN p.n > 0 THEN 'pip' END AS method
FROM corners c LEFT JOIN p USING (zone) LEFT JOIN f USING (zone)""")
def nearest_fallback(spark, d):
    return _nearest_fallback(B.points(spark, d), B.zones(spark, d))


def _nearest_fallback(p, z):
    count = lambda df: df.groupBy("zone").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    primary = z.select("zone").join(count(geometry.points_in_polygons(p, z, "id", "zone", True)), "zone", "left")
    return geometry.with_fallback(primary, count(geometry.nearest_within(p, z, "id", "zone", 5.0)), "zone", "n", ["first"]).select("zone", "n", "first", "method")


def _squares(spark, d):
    """Squares of 4 m around the points."""
    p = B.points(spark, d)
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((-2, -2), (2, -2), (2, 2), (-2, 2))])
    return p.withColumn("rings", F.array(ring))


def _clamped(t: str) -> str:
    """The integral of a value kept between 0 and 1."""
    return f"CASE WHEN {t} <= 0 THEN 0 WHEN {t} >= 1 THEN {t} - 0.5 ELSE {t} * {t} / 2 END"


def _covered_sql(boxes: str, keys: str) -> str:
    """Area of each box (left, top, wide, high; top is its upper y) in each zone: over its edges what lies right of them."""
    return f"""e AS (SELECT {keys}, b.wide * b.high AS box, zone, (x1 - b.l) / b.wide AS u1, (b.t - y1) / b.high AS v1, (x2 - b.l) / b.wide AS u2, (b.t - y2) / b.high AS v2 FROM {boxes} b JOIN edges ON true),
c AS (SELECT *, least(greatest(v1, 0), 1) AS va, least(greatest(v2, 0), 1) AS vb FROM e WHERE v1 <> v2),
p AS (SELECT *, u1 + (va - v1) / (v2 - v1) * (u2 - u1) AS ua, u1 + (vb - v1) / (v2 - v1) * (u2 - u1) AS ub FROM c WHERE va <> vb),
covered AS (SELECT {keys.replace("b.", "")}, zone, abs(sum((vb - va) * (1 - CASE WHEN abs(ub - ua) < 1e-12 THEN least(greatest(ua, 0), 1) ELSE (({_clamped("ub")}) - ({_clamped("ua")})) / (ub - ua) END))) AS share, any_value(box) AS box FROM p GROUP BY ALL)"""


@query(f"""WITH {B.CELLS}, {B.ZONES}, {B.POINTS}, b AS (SELECT id, use, x - 2 AS l, y + 2 AS t, 4.0::DOUBLE AS wide, 4.0::DOUBLE AS high FROM points), {_covered_sql("b", "b.id, b.use")}
SELECT zone, use, count(*) AS n, round(sum(share * box), 6) AS m2, round(sum(share * box) / 1e4, 6) AS ha FROM covered WHERE share * box > 1e-9 GROUP BY 1, 2""")
def overlay_area(spark, d):
    own = geometry.overlay_area(_squares(spark, d), B.zones(spark, d), "id", "zone").join(B.points(spark, d).select("id", "use"), "id")
    return rounded(own.groupBy("zone", "use").agg(F.count("*").alias("n"), F.sum("m2").alias("m2"), (F.sum("m2") / 1e4).alias("ha")))


@query(f"""WITH {B.CELLS}, {B.ZONES}, b AS (SELECT "row", col, t1, col::DOUBLE AS l, -"row"::DOUBLE AS t, 1.0::DOUBLE AS wide, 1.0::DOUBLE AS high FROM cells), {_covered_sql("b", 'b."row", b.col, b.t1')}
SELECT zone, round(sum(t1 * share) / sum(share), 6) AS mean, round(sum(share), 6) AS cells FROM covered WHERE t1 IS NOT NULL AND share > 1e-9 GROUP BY 1""")
def exact_zonal_mean(spark, d):
    return rounded(zonal.weighted_mean(B.cells(spark, d), zonal.coverage(B.zones(spark, d), "zone", B.GRID), "zone", "t1"))


@query(f"""WITH {B.CELLS}, {B.ZONES} SELECT round(sum(a), 4) AS m2, round(sum(a) / 1e6, 4) AS km2 FROM (SELECT zone, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM edges GROUP BY 1)""")
def zone_areas_total(spark, d):
    return rounded(geometry.total_area(B.zones(spark, d), "zone"), 4)


@query(f"""WITH {B.CELLS}, {B.ZONES}, g AS (SELECT zone, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy FROM edges GROUP BY 1)
SELECT zone, round(abs(a), 6) AS m2, round(sx / (6 * a), 6) AS cx, round(sy / (6 * a), 6) AS cy FROM g""")
def zone_centroids(spark, d):
    return rounded(geometry.polygon_centroids(B.zones(spark, d), "zone"))


@query(f"""WITH {B.PARTS}, r AS (SELECT zone, ring, sum(x1 * y2 - x2 * y1) / -2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / -6 AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / -6 AS sy FROM edges GROUP BY 1, 2),
p AS (SELECT zone, CASE ring WHEN 'hole' THEN 'outer' ELSE ring END AS part, sum(a) AS m2, sum(sx) AS sx, sum(sy) AS sy FROM r GROUP BY 1, 2)
SELECT zone, count(*) AS n_parts, round(sum(m2), 6) AS m2, round(sum(sx) / sum(m2), 6) AS cx, round(sum(sy) / sum(m2), 6) AS cy, count(*) FILTER (m2 >= 0.5) AS n_kept, round(sum(m2) FILTER (m2 >= 0.5), 6) AS m2_kept FROM p GROUP BY 1""")
def part_areas(spark, d):
    """Zones of several parts, with holes and islands: area, centroid, and what is left without parts under half a square metre."""
    z = B.part_zones(spark, d)
    n = geometry.parts(z, "zone").groupBy("zone").agg(F.count("*").alias("n_parts"))
    kept = geometry.drop_small_parts(z, "zone").groupBy("zone").agg(F.count("*").alias("n_kept"), F.sum("m2").alias("m2_kept"))
    return rounded(geometry.polygon_centroids(z, "zone").join(n, "zone").join(kept, "zone").select("zone", "n_parts", "m2", "cx", "cy", "n_kept", "m2_kept"))


@query(f"""WITH {B.PARTS}, {B.POINTS}, b AS (SELECT id, use, x - 2 AS l, y + 2 AS t, 4.0::DOUBLE AS wide, 4.0::DOUBLE AS high FROM points), {_covered_sql("b", "b.id, b.use")}
SELECT zone, use, count(*) AS n, round(sum(share * box), 6) AS m2 FROM covered WHERE share * box > 1e-6 GROUP BY 1, 2""")
def part_overlay(spark, d):
    own = geometry.overlay_area(_squares(spark, d), B.part_zones(spark, d), "id", "zone").where("m2 > 1e-6").join(B.points(spark, d).select("id", "use"), "id")
    return rounded(own.groupBy("zone", "use").agg(F.count("*").alias("n"), F.sum("m2").alias("m2")))


@query(f"""WITH {B.CELLS}, {B.PARTS}, b AS (SELECT "row", col, t0, col::DOUBLE AS l, -"row"::DOUBLE AS t, 1.0::DOUBLE AS wide, 1.0::DOUBLE AS high FROM cells), {_covered_sql("b", 'b."row", b.col, b.t0')}
SELECT zone, round(sum(t0 * share) / sum(share), 6) AS mean, round(sum(share), 6) AS cells FROM covered WHERE share > 1e-9 GROUP BY 1""")
def part_zonal_mean(spark, d):
    return rounded(zonal.weighted_mean(B.cells(spark, d), zonal.coverage(B.part_zones(spark, d), "zone", B.GRID), "zone", "t0"))


@query(f"WITH {B.PARTS}, {B.POINTS} SELECT zone, count(*) AS n, sum(id)::BIGINT AS ids FROM point_zones GROUP BY 1")
def points_in_parts(spark, d):
    own = geometry.points_in_polygons(B.points(spark, d), B.part_zones(spark, d), "id", "zone", most_edges=4)
    return own.groupBy("zone").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {B.POINTS.split(', point_zones')[0].rstrip().removesuffix(',')}, g AS (SELECT unnest(range(0, 100)) AS col), h AS (SELECT unnest(range(0, 100)) AS "row")
SELECT "row"::INT AS "row", col::INT AS col, round(avg(value), 9) AS value FROM points p JOIN g ON col + 1 >= x - 2 AND col <= x + 2 JOIN h ON -"row" >= y - 2 AND -("row" + 1) <= y + 2
WHERE col >= floor(x - 2) AND col <= floor(x + 2) AND "row" >= floor(-(y + 2)) AND "row" <= floor(-(y - 2)) GROUP BY 1, 2""")
def rasterise_mean(spark, d):
    own = geometry.rasterise_mean(_squares(spark, d), "id", Grid(0.0, 0.0, 1.0, 1.0, 100, 100), ["value"])
    return rounded(own, 9)


def _d(x: float) -> str:
    return f"({x!r})::DOUBLE"


def _national_grid_sql() -> str:
    """Geocentric coordinates, the seven-parameter shift, and the series of the transverse Mercator projection, a step a table."""
    (a, b), (a1, b1), s = geometry.WGS84, geometry.AIRY, geometry.SHIFT
    e2, f2, n = 1 - b * b / (a * a), 1 - b1 * b1 / (a1 * a1), (a1 - b1) / (a1 + b1)
    rx, ry, rz = (_d(math.radians(s[k] / 3600)) for k in ("rx", "ry", "rz"))
    scale, k, lat0 = _d(1 + s["ppm"] * 1e-6), _d(a1 * geometry.SCALE), _d(math.radians(geometry.LAT0))
    arc = [_d(x) for x in (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3, 3 * n + 3 * n**2 + 21 / 8 * n**3, 15 / 8 * n**2 + 15 / 8 * n**3, 35 / 24 * n**3)]
    return f"""p AS (SELECT id, radians(x / 50 - 2) AS lam, radians(50.5 - y / 50) AS phi FROM points WHERE x / 50 - 2 > -2 AND x / 50 - 2 < 2 AND 50.5 - y / 50 > 50 AND 50.5 - y / 50 < 53),
c AS (SELECT *, {_d(a)} / sqrt(1 - {_d(e2)} * sin(phi) * sin(phi)) AS nu FROM p), g AS (SELECT id, nu * cos(phi) * cos(lam) AS x, nu * cos(phi) * sin(lam) AS y, nu * {_d(1 - e2)} * sin(phi) AS z FROM c),
t AS (SELECT id, {_d(s["tx"])} + {scale} * x - {rz} * y + {ry} * z AS x, {_d(s["ty"])} + {rz} * x + {scale} * y - {rx} * z AS y, {_d(s["tz"])} - {ry} * x + {rx} * y + {scale} * z AS z FROM g),
h AS (SELECT id, z, sqrt(x * x + y * y) AS r, atan2(y, x) - {_d(math.radians(geometry.LON0))} AS dl, atan2(z * {_d(a1)}, r * {_d(b1)}) AS th FROM t),
f AS (SELECT id, dl, atan2(z + {_d(f2 / (1 - f2) * b1)} * pow(sin(th), 3), r - {_d(f2 * a1)} * pow(cos(th), 3)) AS phi FROM h),
v AS (SELECT *, sin(phi) AS s, cos(phi) AS c, tan(phi) * tan(phi) AS t2, {k} / sqrt(1 - {_d(f2)} * s * s) AS nu, {k} * {_d(1 - f2)} / pow(1 - {_d(f2)} * s * s, 1.5) AS rho, nu / rho - 1 AS eta, phi - {lat0} AS d, phi + {lat0} AS u FROM f),
m AS (SELECT *, {_d(b1 * geometry.SCALE)} * ({arc[0]} * d - {arc[1]} * sin(d) * cos(u) + {arc[2]} * sin(2 * d) * cos(2 * u) - {arc[3]} * sin(3 * d) * cos(3 * u)) AS arc FROM v)
SELECT id, round({_d(geometry.EAST0)} + nu * c * dl + nu / 6 * pow(c * dl, 3) * (nu / rho - t2) + nu / 120 * pow(c * dl, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta), 2) AS east,
round({_d(geometry.NORTH0)} + arc + nu / 2 * s * c * dl * dl + nu / 24 * s * pow(c, 3) * (5 - t2 + 9 * eta) * pow(dl, 4) + nu / 720 * s * pow(c, 5) * (61 - 58 * t2 + t2 * t2) * pow(dl, 6), 2) AS north FROM m"""


@query(f"WITH {B.CELLS}, {B.ZONES}, {B.POINTS}, {_national_grid_sql()}")
def national_grid(spark, d):
    p = B.points(spark, d).select("id", (F.col("x") / 50 - 2).alias("lon"), (50.5 - F.col("y") / 50).alias("lat"))
    east, north = geometry.to_national_grid(F.col("lon"), F.col("lat"))
    own = p.where(observations.in_box(F.col("lon").cast("string"), F.col("lat").cast("string"), (-2, 50, 2, 53)))
    return rounded(own.select("id", east.alias("east"), north.alias("north")), 2)


# ---- scenario tables


@query(f"WITH {B.LONG} SELECT unit, year, lc_scenario, value, round(value - max(value) FILTER (lc_scenario = 'N') OVER (PARTITION BY year, unit), 6) AS change FROM long")
def lc_effect_within_year(spark, d):
    return rounded(scenario.within_year_change(B.scenario_long(spark, d), "N"))


_BASE = "b AS (SELECT unit, value AS base FROM long WHERE year = 1996 AND lc_scenario = 'N')"


@query(f"WITH {B.LONG}, {_BASE} SELECT unit, year, lc_scenario, value, round(value - base, 6) AS change FROM long JOIN b USING (unit)")
def effect_vs_year0(spark, d):
    return rounded(scenario.change_from(B.scenario_long(spark, d), 1996, "N"))


@query(f"""WITH {B.LONG}, {_BASE}, e AS (SELECT year, lc_scenario, 'lc effect' AS label, value - max(value) FILTER (lc_scenario = 'N') OVER (PARTITION BY year, unit) AS change FROM long UNION ALL SELECT year, lc_scenario, 'climate+lc effect', value - base FROM long JOIN b USING (unit)),
s AS (SELECT year, lc_scenario, label, count(*) AS n, avg(change) AS mean, stddev_samp(change) AS sd FROM e WHERE year <> 1996 GROUP BY 1, 2, 3)
SELECT year, lc_scenario, label, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(sd / sqrt(n), 5) AS se, round(mean - 1.96 * sd / sqrt(n), 5) AS ci_low, round(mean + 1.96 * sd / sqrt(n), 5) AS ci_high FROM s""")
def effects_combined(spark, d):
    own = B.scenario_long(spark, d)
    both = scenario.combined_effects(scenario.within_year_change(own, "N"), scenario.change_from(own, 1996, "N"), 1996)
    return rounded(scenario.summary(both, ["year", "lc_scenario", "label"], "change"), 5)


@query(f"WITH {B.LONG} SELECT lc_scenario, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {k}" for k, p in {"p2_5": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p97_5": 0.975}.items()) + " FROM long GROUP BY 1")
def quantile_summary(spark, d):
    return rounded(scenario.quantiles(B.scenario_long(spark, d), ["lc_scenario"], "value"))


@query(f"WITH {B.LONG}, q AS (SELECT year, " + ", ".join(f"quantile_cont(value, {p}) AS {k}" for k, p in {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p80": 0.8, "p90": 0.9}.items()) + " FROM long GROUP BY 1) SELECT year, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p80, 6) AS p80, round(p90, 6) AS p90, round(p75 - p25, 6) AS iqr, round(p75 + 1.5 * (p75 - p25), 6) AS upper FROM q")
def box_whiskers(spark, d):
    return rounded(scenario.box_stats(B.scenario_long(spark, d), ["year"], "value"))


@query(f"WITH {B.LONG}, w AS (SELECT lc_scenario, year, avg(value) AS value FROM long GROUP BY 1, 2) SELECT lc_scenario, round(avg(year), 6) AS year, round(avg(value), 6) AS value FROM w GROUP BY 1")
def scenario_year_means(spark, d):
    yearly = B.scenario_long(spark, d).groupBy("lc_scenario", "year").agg(F.avg("value").alias("value"))
    return rounded(scenario.numeric_means(yearly, ["lc_scenario"]))


@query(f"WITH {B.LONG}, w AS (SELECT unit, year, max(value) FILTER (lc_scenario = 'A') AS \"A\", max(value) FILTER (lc_scenario = 'N') AS \"N\", max(value) FILTER (lc_scenario = 'R') AS \"R\" FROM long GROUP BY 1, 2) SELECT *, round(\"A\" - \"N\", 6) AS a_n, round(\"R\" - \"N\", 6) AS r_n FROM w")
def wide_differences(spark, d):
    wide = scenario.wide(B.scenario_long(spark, d), ["unit", "year"], "lc_scenario", ["value"], ["A", "N", "R"])
    return rounded(scenario.differences(wide, {"a_n": ("A", "N"), "r_n": ("R", "N")}))


@query("""WITH w AS (SELECT s_suppkey AS unit, s_acctbal AS balance, s_nationkey::DOUBLE AS nation FROM supplier) SELECT unit, 'balance' AS name, balance AS value FROM w UNION ALL SELECT unit, 'nation', nation FROM w""")
def long_metrics(spark, d):
    own = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return scenario.long(own, ["unit"], ["balance", "nation"])


@query(f"""WITH {B.LONG}, m AS (SELECT unit % 25 AS area, lc_scenario AS scenario, year, unit % 4 AS model, avg(value) AS mean FROM long GROUP BY 1, 2, 3, 4), e AS (SELECT area, scenario, year, avg(mean) AS mean, count(DISTINCT model) AS models FROM m GROUP BY 1, 2, 3),
b AS (SELECT area, avg(mean) AS mean FROM e WHERE scenario = 'N' AND year = 1996 GROUP BY 1) SELECT area, scenario, year, models, round(e.mean, 9) AS mean_s, round(b.mean, 9) AS mean_b, round(e.mean - b.mean, 9) AS mean_diff FROM e JOIN b USING (area)""")
def ensemble_delta(spark, d):
    own = B.scenario_long(spark, d).groupBy((F.col("unit") % 25).alias("area"), F.col("lc_scenario").alias("scenario"), "year", (F.col("unit") % 4).alias("model")).agg(F.avg("value").alias("mean"))
    e = scenario.ensemble_mean(own, ["area", "scenario", "year"], "mean")
    base = e.where("scenario = 'N' AND year = 1996").select("area", "mean")
    return rounded(scenario.against_baseline(e, base, "area"), 9)


@query("""WITH b AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT k, coalesce(b.v, 0) AS before, coalesce(a.v, 0) AS after, coalesce(a.v, 0) - coalesce(b.v, 0) AS change FROM b FULL JOIN a USING (k)""")
def before_after_change(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("t"))
    n = lambda df: df.groupBy("k").agg(F.count("*").cast("double").alias("v"))
    return scenario.before_after(n(o.where("t < '1997-01-01'")), n(o.where("t >= '1997-01-01' AND k <> '5-LOW'")), "k", "v")


_RUN = "'s0_' || (['s1','s2','s3','s41','s42','s43','s510','s520','s530','s99'])[1 + (l_orderkey % 10)::INT] || (CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '_2050_2050' ELSE '_2021_2070' END)"


def _runs(spark, d):
    codes = F.array(*map(F.lit, ["s1", "s2", "s3", "s41", "s42", "s43", "s510", "s520", "s530", "s99"]))
    tail = F.when(F.col("l_linenumber") % 3 == 0, "").when(F.col("l_linenumber") % 3 == 1, "_2050_2050").otherwise("_2021_2070")
    return B.table(spark, d, "lineitem").select(F.concat(F.lit("s0_"), F.get(codes, (F.col("l_orderkey") % 10).cast("int")), tail).alias("run"), F.round(F.col("l_quantity")).cast("long").alias("q"))


@query(f"""WITH r AS (SELECT {_RUN} AS run, round(l_quantity)::BIGINT AS q FROM lineitem), p AS (SELECT *, coalesce(nullif(regexp_extract(run, '\\d{{4}}_\\d{{4}}'), ''), '2021_2050') AS period, regexp_replace(regexp_replace(run, '_\\d{{4}}_\\d{{4}}', ''), '^s0_', '') AS code FROM r),
n AS (SELECT *, {_case('code', classify.SCENARIOS)} AS lc_scenario, CASE WHEN split_part(period, '_', 1) = split_part(period, '_', 2) THEN 'lc effect' ELSE 'climate+lc effect' END AS label FROM p)
SELECT lc_scenario, {_case('lc_scenario', classify.SCENARIO_LABELS)} AS name, label, count(*) AS n, sum(CASE WHEN lc_scenario IN ('scenario1', 'scenario2_TR') THEN q WHEN lc_scenario IN ('scenario3_TO', 'scenario4_10') THEN -q END)::BIGINT AS signed FROM n GROUP BY 1, 2, 3""")
def scenario_recode(spark, d):
    start, end = classify.period_parts(F.col("run"))
    own = _runs(spark, d).withColumns({"label": classify.effect_type(start, end), "lc_scenario": classify.scenario(F.regexp_replace("run", r"_\d{4}_\d{4}", ""))})
    signed = classify.signed_effect(F.col("lc_scenario"), F.col("q"), ["scenario1", "scenario2_TR"], ["scenario3_TO", "scenario4_10"])
    return own.groupBy("lc_scenario", classify.scenario_label(F.col("lc_scenario")).alias("name"), "label").agg(F.count("*").alias("n"), F.sum(signed).alias("signed"))


_PATH = "'/runs/sc' || (p_size % 5) || '/out/T_air_scenario_' || (['20.0deg_2.0','22deg_2','22.0deg_5.0','25.0deg_5','28deg_5.0','30deg_1','bad'])[1 + (p_partkey % 7)::INT] || 'uhi_50hum.tif'"


@query(f"""WITH p AS (SELECT {_PATH} AS path FROM part), m AS (SELECT path, regexp_extract(path, '^/runs/([^/]+)/', 1) AS f, regexp_extract(path, 'scenario_([\\d.]+)deg_([\\d.]+)uhi', 1) AS g, regexp_extract(path, 'scenario_([\\d.]+)deg_([\\d.]+)uhi', 2) AS u FROM p),
s AS (SELECT CASE WHEN g <> '' THEN f || '_' || trunc(g::DOUBLE)::INT || '_' || trunc(u::DOUBLE)::INT END AS short_name FROM (SELECT f, nullif(g, '') AS g, nullif(u, '') AS u FROM m))
SELECT short_name, {_case("regexp_extract(short_name, '_(\\d+_\\d+)$', 1)", classify.CLIMATE_CASES)} AS year, count(*) AS n FROM s GROUP BY 1, 2""")
def climate_case_recode(spark, d):
    cases = F.array(*map(F.lit, ["20.0deg_2.0", "22deg_2", "22.0deg_5.0", "25.0deg_5", "28deg_5.0", "30deg_1", "bad"]))
    path = F.concat(F.lit("/runs/sc"), F.col("p_size") % 5, F.lit("/out/T_air_scenario_"), F.get(cases, (F.col("p_partkey") % 7).cast("int")), F.lit("uhi_50hum.tif"))
    own = B.table(spark, d, "part").select(text.short_name(path, "/runs").alias("short_name"))
    return own.groupBy("short_name", classify.climate_year(F.col("short_name")).alias("year")).agg(F.count("*").alias("n"))


# ---- vulnerability and equity


_RANKED = "r AS (SELECT id, area, " + ", ".join(f"CASE WHEN {m} IS NOT NULL THEN percent_rank() OVER (PARTITION BY {m} IS NULL ORDER BY {m}) END AS p_{m}" for m in ("m1", "m2", "m3")) + " FROM units)"
_SCORED = _RANKED + ", s AS (SELECT *, (coalesce(p_m1, 0) + coalesce(p_m2, 0) + coalesce(p_m3, 0)) / ((p_m1 IS NOT NULL)::INT + (p_m2 IS NOT NULL)::INT + (p_m3 IS NOT NULL)::INT) AS score FROM r)"


@query(f"WITH {B.UNITS}, {_SCORED} SELECT id, round(p_m1, 6) AS p_m1, round(p_m2, 6) AS p_m2, round(p_m3, 6) AS p_m3, round(score, 6) AS score, round(percent_rank() OVER (ORDER BY round(score, 9)), 6) AS score_pct, dense_rank() OVER (ORDER BY round(score, 9) DESC)::INT AS score_rank FROM s")
def svi_percentile(spark, d):
    own = vulnerability.index(B.units(spark, d), "id", ["m1", "m2", "m3"]).withColumn("score", F.round("score", 9))
    return rounded(vulnerability.with_score_ranks(own))


@query(f"WITH {B.UNITS}, {_SCORED}, a AS (SELECT area, round(avg(score), 9) AS score, count(*) AS units FROM s GROUP BY 1) SELECT area, round(score, 6) AS score, units, round(percent_rank() OVER (ORDER BY score), 6) AS score_pct, dense_rank() OVER (ORDER BY score DESC)::INT AS score_rank FROM a")
def borough_svi(spark, d):
    u = B.units(spark, d)
    own = vulnerability.rolled_up(vulnerability.index(u, "id", ["m1", "m2", "m3"]), u, "id", "area").withColumn("score", F.round("score", 9))
    return rounded(vulnerability.with_score_ranks(own))


@query(f"""WITH {B.UNITS}, b AS (SELECT list_sort(list_distinct(quantile_cont(m1, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS b1, list_sort(list_distinct(quantile_cont(m3, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS b3 FROM units),
r AS (SELECT *, CASE WHEN m3 IS NOT NULL THEN percent_rank() OVER (PARTITION BY m3 IS NULL ORDER BY m3) END AS p3 FROM units, b)
SELECT id, CASE WHEN m1 IS NOT NULL THEN greatest(len([x FOR x IN b1 IF x < m1]), 1) END::INT AS q1, greatest(ceil(round(p3 * 5, 9)), 1)::INT AS q3, greatest(len([x FOR x IN b3 IF x < m3]), 1)::INT AS q3_few FROM r""")
def svi_quintile(spark, d):
    own = vulnerability.quantile_bins(B.units(spark, d), {"q1": ("m1", True), "q3": ("m3", True), "q3_few": ("m3", False)}, 5)
    return own.select("id", F.col("q1").cast("int"), F.col("q3").cast("int"), F.col("q3_few").cast("int"))


@query(f"WITH {B.UNITS} SELECT id, CASE WHEN m1 IS NOT NULL THEN ntile(5) OVER (PARTITION BY m1 IS NULL ORDER BY m1, id) END::INT AS bucket, coalesce(m2, 0) + coalesce(m3, 0) AS total FROM units")
def equal_buckets(spark, d):
    return vulnerability.with_bucket(B.units(spark, d), "m1", 5, "id", "bucket").select("id", "bucket", vulnerability.row_sum(["m2", "m3"]).alias("total"))


@query(f"WITH {B.UNITS} SELECT id, " + ", ".join(f"round(({m} - avg({m}) OVER ()) / stddev_samp({m}) OVER (), 6) AS z_{m}" for m in ("m1", "m2", "m4")) + " FROM units")
def zscore_metrics(spark, d):
    return rounded(vulnerability.zscore(B.units(spark, d), ["m1", "m2", "m4"]).select("id", "z_m1", "z_m2", "z_m4"))


_LONGM = "SELECT id, 'm1' AS metric, m1 AS value, population FROM units UNION ALL SELECT id, 'm2', m2, population FROM units UNION ALL SELECT id, 'm4', m4, population FROM units"


def _metrics(spark, d):
    return B.units(spark, d).unpivot(["id", "population"], ["m1", "m2", "m4"], "metric", "value")


@query(f"""WITH {B.UNITS}, l AS ({_LONGM}), e AS (SELECT metric, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM l GROUP BY 1) SELECT metric, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS largest FROM l JOIN e USING (metric) WHERE value BETWEEN lo AND hi GROUP BY 1""")
def quantile_trim(spark, d):
    return rounded(vulnerability.quantile_trim(_metrics(spark, d)).groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest")))


@query(f"""WITH {B.UNITS}, c AS (SELECT id, 'Green30' AS lc_scenario, (id % 29 <> 0)::INT AS n FROM units UNION ALL SELECT id, 'Target30', (id % 31 <> 0)::INT FROM units) SELECT id, lc_scenario, n::BIGINT AS n FROM c WHERE n <> 1 AND NOT (id % 29 = 0 AND id % 31 = 0)""")
def pairing_violations(spark, d):
    return vulnerability.pairing_violations(B.paired_cases(spark, d), "id", ["Green30", "Target30"])


def _vulnerable(spark, d):
    pairs = vulnerability.paired(B.paired_cases(spark, d), "id", "Green30", "Target30", ["m1", "m2", "m3", "population"])
    return vulnerability.vulnerable(vulnerability.benefit_classes(pairs), "id", ["m1", "m2", "m3"], "population")


@query(f"""WITH {B.UNITS}, {B.PAIRED}, h AS (SELECT *, benefit_first = 'Low' AS a, benefit_second = 'Low' AS b FROM vuln WHERE high)
SELECT metric, count(*) AS n_high, sum(population) AS population_high, count(*) FILTER (a) AS n_low_first, count(*) FILTER (b) AS n_low_second, round(100 * count(*) FILTER (a) / count(*), 6) AS pct_low_first, round(100 * count(*) FILTER (b) / count(*), 6) AS pct_low_second,
round(100 * (count(*) FILTER (b) - count(*) FILTER (a)) / count(*), 6) AS change_points, count(*) FILTER (a AND NOT b) AS n_resolved, round(100 * count(*) FILTER (a AND NOT b) / nullif(count(*) FILTER (a), 0), 6) AS pct_resolved, count(*) FILTER (NOT a AND b) AS n_new,
round(sum(delta_cases), 6) AS deaths_averted_more, round(100 * (sum(cases_second) / sum(cases_first) - 1), 6) AS pct_change_averted, round(100 * sum(population) FILTER (a) / sum(population), 6) AS population_pct_first, round(100 * sum(population) FILTER (b) / sum(population), 6) AS population_pct_second FROM h GROUP BY 1""")
def paired_benefit(spark, d):
    return rounded(vulnerability.headline(_vulnerable(spark, d)))


@query(f"""WITH {B.UNITS}, {B.PAIRED}, n AS (SELECT metric, benefit_first, benefit_second, count(*) AS n FROM vuln WHERE high GROUP BY 1, 2, 3), v AS (SELECT unnest(['Low', 'Moderate', 'High']) AS v),
g AS (SELECT metric, a.v AS benefit_first, b.v AS benefit_second FROM (SELECT DISTINCT metric FROM n), v a, v b) SELECT metric, benefit_first, benefit_second, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY metric), 6) AS pct FROM g LEFT JOIN n USING (metric, benefit_first, benefit_second)""")
def paired_transitions(spark, d):
    return rounded(vulnerability.transitions(_vulnerable(spark, d)))


@query(f"""WITH {B.UNITS}, {B.PAIRED} SELECT round(sum(cases_first), 4) AS first, round(sum(cases_second), 4) AS second, round(sum(cases_second) - sum(cases_first), 4) AS difference, round(100 * sum(cases_second) / sum(cases_first), 4) AS retention_pct FROM pairs""")
def paired_citywide(spark, d):
    return rounded(vulnerability.citywide(vulnerability.paired(B.paired_cases(spark, d), "id", "Green30", "Target30", ["population"])), 4)


@query(f"""WITH {B.UNITS}, u AS (SELECT * FROM units WHERE m1 IS NOT NULL), b AS (SELECT quantile_cont(m1, 1/3::DOUBLE) AS a1, quantile_cont(m1, 2/3::DOUBLE) AS a2, quantile_cont(m4, 1/3::DOUBLE) AS b1, quantile_cont(m4, 2/3::DOUBLE) AS b2 FROM u),
c AS (SELECT (1 + (m1 > a1)::INT + (m1 > a2)::INT) || '-' || (1 + (m4 > b1)::INT + (m4 > b2)::INT) AS bi_class, count(*) AS n FROM u, b GROUP BY 1) SELECT bi_class, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM c""")
def bivariate_classes(spark, d):
    return rounded(vulnerability.bivariate_counts(B.units(spark, d), "m1", "m4"))


# ---- statistics


@query(f"""WITH {B.LONG}, s AS (SELECT lc_scenario, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY 1)
SELECT a.lc_scenario AS lc_scenario_a, b.lc_scenario AS lc_scenario_b, a.n AS n_a, b.n AS n_b, round(a.m - b.m, 6) AS diff, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM s a JOIN s b ON a.lc_scenario < b.lc_scenario""")
def welch_pairs(spark, d):
    own = stats.t_tests(B.scenario_long(spark, d), "lc_scenario", "value")
    return rounded(own).withColumn("df", F.round("df", 4))


@query()
def welch_p_values(spark, d):
    own = stats.t_tests(B.scenario_long(spark, d), "lc_scenario", "value")
    p = stats.t_p_value(F.col("t"), F.col("df"))
    return own.select("lc_scenario_a", "lc_scenario_b", F.round(p, 9).alias("p")).withColumn("mark", text.stars(F.col("p")))


@query(f"""WITH {B.LONG}, s AS (SELECT lc_scenario, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY 1)
SELECT a.lc_scenario AS lc_scenario_a, b.lc_scenario AS lc_scenario_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS t, (a.n + b.n - 2)::DOUBLE AS df FROM s a JOIN s b ON a.lc_scenario < b.lc_scenario""")
def pooled_pairs(spark, d):
    return rounded(stats.t_tests(B.scenario_long(spark, d), "lc_scenario", "value", equal_var=True).select("lc_scenario_a", "lc_scenario_b", "t", "df"))


@query(f"""WITH {B.LONG}, s AS (SELECT year, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1), t AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS w FROM s)
SELECT k - 1 AS df1, n - k AS df2, round(((SELECT sum(s.n * pow(s.m - t.mean, 2)) FROM s) / (k - 1)) / (w / (n - k)), 4) AS f FROM t""")
def anova_one_way(spark, d):
    return rounded(stats.anova(B.scenario_long(spark, d), "year", "value"), 4)


_TIED = "x AS (SELECT lc_scenario AS g, round(value)::BIGINT AS v FROM long)"
_RANKS = _TIED + ", r AS (SELECT *, avg(rn) OVER (PARTITION BY v) AS rank, count(*) OVER (PARTITION BY v) AS ties FROM (SELECT *, row_number() OVER (ORDER BY v) AS rn FROM x)), t AS (SELECT count(*)::DOUBLE AS n, sum(ties::DOUBLE * ties - 1) AS tie FROM r), s AS (SELECT g, count(*) AS n, sum(rank) AS rs FROM r GROUP BY 1)"


def _tied(spark, d):
    return B.scenario_long(spark, d).select(F.col("lc_scenario").alias("g"), F.round("value").cast("long").alias("v"))


@query(f"WITH {B.LONG}, {_RANKS} SELECT round((12 / (t.n * (t.n + 1)) * (SELECT sum(rs * rs / n) FROM s) - 3 * (t.n + 1)) / (1 - tie / (t.n * t.n * t.n - t.n)), 4) AS h, (SELECT count(*) - 1 FROM s) AS df FROM t")
def kruskal(spark, d):
    return rounded(stats.kruskal(_tied(spark, d), "g", "v"), 4)


@query(f"""WITH {B.LONG}, {_RANKS} SELECT a.g AS g_a, b.g AS g_b, round((a.rs / a.n - b.rs / b.n) / sqrt((t.n * (t.n + 1) / 12 - tie / (12 * (t.n - 1))) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS z, count(*) OVER () AS pairs FROM s a JOIN s b ON a.g < b.g, t""")
def dunn_pairs(spark, d):
    return rounded(stats.dunn(_tied(spark, d), "g", "v"))


@query()
def dunn_p_values(spark, d):
    own = stats.dunn(_tied(spark, d), "g", "v")
    return own.select("g_a", "g_b", F.round(stats.bonferroni(stats.z_p_value(F.col("z")), F.col("pairs")), 9).alias("p"))


@query()
def dunn_letters(spark, d):
    """Brands of parts that do not differ in size share a letter, within each kind."""
    part = B.table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("v"))
    own = stats.dunn(part, "g", "v", ["kind"])
    return stats.letter_display(own.withColumn("p", stats.bonferroni(stats.z_p_value(F.col("z")), F.col("pairs"))), "g", by=["kind"])


@query(f"""WITH {B.LONG}, {_TIED}, p AS (SELECT a.g AS g_a, b.g AS g_b FROM (SELECT DISTINCT g FROM x) a JOIN (SELECT DISTINCT g FROM x) b ON a.g < b.g), o AS (SELECT g_a, g_b, g, v FROM x JOIN p ON g = g_a OR g = g_b),
r AS (SELECT *, avg(rn) OVER (PARTITION BY g_a, g_b, v) AS rank, count(*) OVER (PARTITION BY g_a, g_b, v)::DOUBLE AS ties FROM (SELECT *, row_number() OVER (PARTITION BY g_a, g_b ORDER BY v) AS rn FROM o)),
s AS (SELECT g_a, g_b, count(*) FILTER (g = g_a)::DOUBLE AS a, count(*) FILTER (g = g_b)::DOUBLE AS b, sum(rank) FILTER (g = g_a) AS r, sum(ties * ties - 1) AS tie FROM r GROUP BY 1, 2), w AS (SELECT *, r - a * (a + 1) / 2 AS w FROM s)
SELECT g_a, g_b, w, round((w - a * b / 2 - sign(w - a * b / 2) * 0.5::DOUBLE) / sqrt(a * b / 12 * (a + b + 1 - tie / ((a + b) * (a + b - 1)))), 6) AS z FROM w""")
def ranksum_pairs(spark, d):
    return rounded(stats.rank_sum(_tied(spark, d), "g", "v").select("g_a", "g_b", "w", "z"))


@query()
def ranksum_p_values(spark, d):
    """Prices of parts by brand, exact where a brand has few and none are equal, and by brand and size."""
    part = B.table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("size"), (F.col("p_retailprice") + F.col("p_partkey") / 1e7).alias("v"))
    own = stats.rank_sum(part, "g", "v", ["size"])
    return own.select("size", "g_a", "g_b", "n_a", "n_b", "w", F.round(stats.rank_sum_p_value(own), 9).alias("p"))


@query(f"""WITH {B.UNITS}, u AS (SELECT * FROM units WHERE m1 IS NOT NULL) """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n, round(corr({a}, {b}) * sqrt((count(*) - 2) / (1 - corr({a}, {b}) * corr({a}, {b}))), 5) AS t FROM u" for a, b in (("m1", "m2"), ("m1", "m4"), ("m2", "m4"))))
def metric_correlation(spark, d):
    own = stats.correlations(B.units(spark, d), ["m1", "m2", "m4"])
    return own.select("a", "b", F.round("r", 6).alias("r"), "n", F.round(stats.correlation_t(F.col("r"), F.col("n")), 5).alias("t"))


@query(f"""WITH {B.UNITS}, l AS ({_LONGM}), s AS (SELECT metric, count(*) AS n, regr_slope(population, value) AS slope, regr_intercept(population, value) AS intercept, regr_r2(population, value) AS r2, regr_sxx(population, value) AS sxx, regr_syy(population, value) AS syy FROM l WHERE value IS NOT NULL GROUP BY 1)
SELECT metric, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(sqrt(syy * (1 - r2) / (n - 2) / sxx), 6) AS se, round(slope / sqrt(syy * (1 - r2) / (n - 2) / sxx), 5) AS t FROM s""")
def metric_ols(spark, d):
    own = stats.ols(_metrics(spark, d), x="value", y="population")
    return rounded(own, 9).withColumns({"slope": F.round("slope", 6), "r2": F.round("r2", 6), "se": F.round("se", 6), "intercept": F.round("intercept", 4), "t": F.round("t", 5)})


@query()
def spline_curve(spark, d):
    return rounded(stats.spline_curves(_metrics(spark, d), 10, x="value", y="population")[0], 4)


@query()
def basis_sensitivity(spark, d):
    return rounded(stats.compare_fits(stats.spline_curves(_metrics(spark, d), [5, 7, 9], x="value", y="population")[1]), 4)


@query()
def gamma_fit(spark, d):
    return rounded(stats.gamma_regression(B.units(spark, d).select("m2", "m3", F.col("population").alias("y")), ["m2", "m3"], "y"))


@query(f"""WITH {B.UNITS}, s AS (SELECT min(m4) AS lo, max(m4) AS hi, stddev_samp(m4) AS sd, count(m4)::DOUBLE AS n, quantile_cont(m4, 0.75) - quantile_cont(m4, 0.25) AS iqr FROM units),
p AS (SELECT lo, n, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS h, (hi - lo) / 511 AS step FROM s), b AS (SELECT floor((m4 - lo) / (h / 20)) AS bin, count(*) AS c, avg(m4) AS m FROM units, p WHERE m4 IS NOT NULL GROUP BY 1)
SELECT round(lo + i * step, 6) AS x, round(sum(c * exp(-pow((lo + i * step - m) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 6) AS density FROM b, p, range(512) r(i) WHERE abs(lo + i * step - m) <= 6 * h GROUP BY i, lo, step, n, h""")
def density_curve(spark, d):
    return rounded(stats.density(B.units(spark, d), "m4"))


# ---- observations


@query(f"""WITH {B.OBS} SELECT station, ts::DATE AS date, CASE WHEN hour(ts) BETWEEN 8 AND 19 THEN 'day' ELSE 'night' END AS day_night, ((dayofyear(ts) - 1) // 7 + 1)::INT AS week, (['winter', 'spring', 'summer', 'fall'])[quarter(ts)] AS season, round(avg(temperature), 6) AS mean FROM obs GROUP BY 1, 2, 3, 4, 5""")
def obs_daily_daynight(spark, d):
    return rounded(observations.daily_day_night(B.observations(spark, d), "station", "ts", "temperature"))


@query(f"""WITH {B.OBS}, a AS (SELECT station, ts::DATE AS date, avg(temperature) AS mean FROM obs WHERE hour(ts) BETWEEN 8 AND 19 GROUP BY 1, 2) SELECT station, date_trunc('month', date)::DATE AS month, round(avg(mean), 6) AS mean, count(*) AS days FROM a GROUP BY 1, 2""")
def obs_monthly_daytime(spark, d):
    return rounded(observations.monthly_daytime(observations.daily_day_night(B.observations(spark, d), "station", "ts", "temperature"), "station"))


@query(f"""WITH {B.OBS} SELECT station, date_trunc('month', ts)::DATE AS month, round(avg(temperature), 6) AS mean, max(temperature) AS largest, min(temperature) AS least FROM obs GROUP BY 1, 2""")
def lsoa_monthly(spark, d):
    return rounded(observations.monthly(B.observations(spark, d), "station", "ts", "temperature"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderdate::DATE AS day FROM orders), s AS (SELECT o_custkey AS k, year(o_orderdate) || '_' || CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' WHEN month(o_orderdate) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS year_season, round(o_totalprice)::BIGINT AS v FROM orders),
n AS (SELECT k, year_season, max(v) AS ndvi FROM s GROUP BY 1, 2), b AS (SELECT k, day, year(day) || '_' || CASE WHEN month(day) IN (3, 4, 5) THEN 'Spring' WHEN month(day) IN (6, 7, 8) THEN 'Summer' WHEN month(day) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS year_season FROM a)
SELECT k, year_season, day, ndvi FROM b JOIN n USING (k, year_season)""")
def season_match(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.round("o_totalprice").cast("long").alias("v"))
    ndvi = o.groupBy("k", dates.year_season(F.col("day")).alias("year_season")).agg(F.max("v").alias("ndvi"))
    return observations.season_match(o.select("k", "day"), ndvi, "k", "day")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE + (o_orderkey % 300)::INT AS day FROM orders), i AS (SELECT o_custkey AS k, o_orderdate::DATE AS s, o_orderdate::DATE + (200 + o_orderkey % 7)::INT AS e FROM orders)
SELECT k, day, start, stop, days FROM (SELECT e.k, day, i.s AS start, i.e AS stop, abs(datediff('day', i.s, day))::INT AS days, rank() OVER (PARTITION BY e.k, day ORDER BY abs(datediff('day', i.s, day))) AS r FROM e JOIN i ON e.k = i.k AND day BETWEEN i.s AND i.e) WHERE r = 1""")
def interval_nearest(spark, d):
    """All orders in both roles; as events they come later, as each would be nearest to itself otherwise."""
    o = B.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    held = o.select("k", F.col("day").alias("start"), F.date_add("day", (200 + F.col("o_orderkey") % 7).cast("int")).alias("stop"))
    events = o.select("k", F.date_add("day", (F.col("o_orderkey") % 300).cast("int")).alias("day")).distinct()
    return observations.interval_nearest(events, held, "k", "day", "start", "stop")


@query("""WITH s AS (SELECT user_id, year(min(ts))::INT * 0 + min(event_id)::INT % 50 + 1950 AS first_year, max(event_id)::INT % 20 + 2000 AS last_year FROM events GROUP BY 1) SELECT * FROM s WHERE first_year BETWEEN 1955 AND 1990 AND last_year BETWEEN 2005 AND 2018""")
def active_stations(spark, d):
    s = B.table(spark, d, "events").groupBy("user_id").agg((F.min("event_id") % 50 + 1950).cast("int").alias("first_year"), (F.max("event_id") % 20 + 2000).cast("int").alias("last_year"))
    return observations.active_stations(s, (1955, 1990), (2005, 2018))


@query("""SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::INT)::BIGINT AS k FROM events GROUP BY 1""")
def json_properties(spark, d):
    own = B.table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


# ---- trees, parks and names


@query(f"""WITH {B.TREES}, t AS (SELECT id, "TaxonName" || ' = x' AS full_name FROM trees), k AS (SELECT id, full_name, trim(split_part(full_name, '=', 1)) AS taxon FROM t), sp AS (SELECT DISTINCT "TaxonName" AS species FROM trees WHERE size % 3 = 0 AND "TaxonName" LIKE '%e%'),
rs AS (SELECT "TaxonName" AS taxon, min(replace("TaxonName", 'small', 'red')) AS species FROM trees WHERE replace("TaxonName", 'small', 'red') IN (SELECT species FROM sp) GROUP BY 1)
SELECT k.id, k.taxon, CASE WHEN sp.species IS NOT NULL THEN k.taxon ELSE rs.species END AS matched, CASE WHEN sp.species IS NOT NULL THEN 'exact' WHEN rs.species IS NOT NULL THEN 'resolved' END AS method FROM k LEFT JOIN sp ON sp.species = k.taxon LEFT JOIN rs ON rs.taxon = k.taxon""")
def name_match_two_pass(spark, d):
    t = B.trees(spark, d)
    own = t.select("id", F.concat("TaxonName", F.lit(" = x")).alias("TaxonName")).select("id", trees.taxon().alias("taxon"))
    species = t.where("size % 3 = 0 AND TaxonName LIKE '%e%'").select(F.col("TaxonName").alias("species"))
    resolved = t.select(F.col("TaxonName").alias("taxon"), F.replace("TaxonName", F.lit("small"), F.lit("red")).alias("species"))
    return trees.match_names(own, species, resolved, "taxon", "species", "id")


@query("""WITH p AS (SELECT p_partkey AS id, p_size - 25 AS risk_MAT_2050, p_partkey % 3 - 2 AS risk_MTWM_2070, 10 - p_size AS risk_AP_2050, p_partkey % 5 AS risk_PDQ_2070 FROM part), k AS (SELECT * FROM p WHERE risk_MAT_2050 > 0 OR risk_MTWM_2070 > 0 OR risk_AP_2050 < 0 OR risk_PDQ_2070 < 0)
SELECT id, 'risk_MAT_2050' AS var, risk_MAT_2050::BIGINT AS value, 2050 AS year FROM k UNION ALL SELECT id, 'risk_AP_2050', risk_AP_2050::BIGINT, 2050 FROM k""")
def species_at_risk(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    own = B.table(spark, d, "part").select(k.alias("id"), (s - 25).cast("long").alias("risk_MAT_2050"), (k % 3 - 2).alias("risk_MTWM_2070"), (10 - s).cast("long").alias("risk_AP_2050"), (k % 5).alias("risk_PDQ_2070"))
    return trees.at_risk(own, ["risk_MAT_2050", "risk_MTWM_2070"], ["risk_AP_2050", "risk_PDQ_2070"], ["id"], 2050)


_AGES, _CONDITIONS = ["Over Mature", "Young", None, "dead"], ["Poor", "Good", "pk", None, "Felled"]


@query("""WITH t AS (SELECT (['over mature', 'young', NULL, 'dead'])[1 + (p_partkey % 4)::INT] AS age, (['poor', 'good', NULL, NULL, 'felled'])[1 + (p_size % 5)::INT] AS condition FROM part)
SELECT CASE WHEN age IS NULL AND condition IS NULL THEN NULL WHEN age IN ('over mature', 'dead') OR condition IN ('poor', 'felled') THEN 'dying' ELSE 'not dying' END AS state, count(*) AS n FROM t GROUP BY 1""")
def tree_conditions(spark, d):
    age, condition = F.get(F.array(*map(F.lit, _AGES)), (F.col("p_partkey") % 4).cast("int")), F.get(F.array(*map(F.lit, _CONDITIONS)), F.col("p_size") % 5)
    return B.table(spark, d, "part").groupBy(classify.tree_condition(age, condition).alias("state")).agg(F.count("*").alias("n"))


_USES = ["Country park", "Park", "Playing fields", "Village green", "Allotments", "Road island/verge", "Canal", "", "Other", "Vacant land"]


@query("""WITH u AS (SELECT (['Country park', 'Park', 'Playing fields', 'Village green', 'Allotments', 'Road island/verge', 'Canal', '', 'Other', 'Vacant land'])[1 + (p_partkey % 10)::INT] AS use, CASE WHEN p_size % 2 = 0 THEN 'Green PARK' ELSE p_name END AS name, p_retailprice / 4 - 225 AS ha FROM part),
f AS (SELECT *, CASE WHEN use = '' AND regexp_matches(name, '(?i)park|garden|open space') THEN 'Parks' ELSE use END AS filled, CASE use WHEN 'Country park' THEN '1 Regional Parks' WHEN 'Park' THEN '2 Metropolitan Parks' WHEN 'Playing fields' THEN '3 District Parks' WHEN 'Village green' THEN '4 Local Parks and Open Spaces' WHEN 'Allotments' THEN '5 Small Open Spaces' WHEN 'Road island/verge' THEN '6 Pocket Parks' WHEN 'Canal' THEN '7 Linear Open Spaces' ELSE 'Unclassified' END AS by_name,
CASE WHEN ha > 400 THEN '1 Regional Parks' WHEN ha > 60 THEN '2 Metropolitan Parks' WHEN ha > 20 THEN '3 District Parks' WHEN ha > 2 THEN '4 Local Parks and Open Spaces' WHEN ha > 0.4 THEN '5 Small Open Spaces' WHEN ha > 0 THEN '6 Pocket Parks' ELSE 'Unclassified' END AS by_area FROM u)
SELECT filled, by_name, by_area, by_name AS final, count(*) AS n, count(*) FILTER (use IN ('Road island/verge', 'Vacant land')) AS opportunities FROM f GROUP BY 1, 2, 3""")
def park_classes(spark, d):
    use, ha = F.get(F.array(*map(F.lit, _USES)), (F.col("p_partkey") % 10).cast("int")), F.col("p_retailprice") / 4 - 225
    name = F.when(F.col("p_size") % 2 == 0, "Green PARK").otherwise(F.col("p_name"))
    own = B.table(spark, d, "part").select(use.alias("use"), name.alias("name"), ha.alias("ha"))
    own = own.groupBy(classify.filled_use(F.col("use"), F.col("name")).alias("filled"), classify.park_class_by_name(F.col("use")).alias("by_name"), classify.park_class_by_area(F.col("ha")).alias("by_area"), classify.park_class(F.col("use"), F.col("ha")).alias("final"))
    return own.agg(F.count("*").alias("n"), F.count_if(F.col("use").isin(classify.OPPORTUNITY_USES)).alias("opportunities"))


@query("""WITH a AS (SELECT p_name AS name, p_brand AS brand, p_partkey AS id FROM part WHERE p_size < 25), b AS (SELECT p_name AS name, NULL AS brand, p_partkey AS id FROM part WHERE p_size >= 20), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT name, brand, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id, brand NULLS FIRST) AS k FROM u) WHERE k = 1""")
def union_first(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_size")
    return trees.union_distinct(p.where("p_size < 25").drop("p_size"), p.where("p_size >= 20").select("name", "id"), ["name"], ["id", "brand"])


# ---- profiles


_PROFILED = ["c_mktsegment", "c_nationkey"]


@query("""WITH u AS (SELECT 'c_mktsegment' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer), n AS (SELECT name, value, count(*) AS n FROM u GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value)::INT AS place FROM n) WHERE place <= 10""")
def column_profile_top10(spark, d):
    return profile.top_values(B.table(spark, d, "customer"), _PROFILED)


@query(f"WITH {B.UNITS} " + " UNION ALL ".join(f"SELECT '{m}' AS name, count(*) AS n, count({m}) AS known, count(*) - count({m}) AS missing, round(100 * (count(*) - count({m})) / count(*), 6) AS pct_missing FROM units" for m in ("m1", "m2")))
def missing_profile(spark, d):
    return rounded(profile.missing_profile(B.units(spark, d), ["m1", "m2"]))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return profile.duplicate_keys(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH n AS (SELECT coalesce((CASE WHEN o_custkey % 6 <> 0 THEN 2050 + o_custkey % 3 END)::VARCHAR, 'Unknown') AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM n""")
def year_frequency(spark, d):
    k = F.col("o_custkey")
    return rounded(profile.frequency(B.table(spark, d, "orders").select(F.when(k % 6 != 0, 2050 + k % 3).alias("year")), "year"))


@query("""WITH b AS (SELECT ceil((c_acctbal + 1000) / 500)::BIGINT - 1 AS bin, c_acctbal FROM customer) SELECT bin, count(*) AS n, round(avg(c_acctbal), 6) AS mean, bin * 500.0::DOUBLE - 1000 AS "from" FROM b GROUP BY 1""")
def balance_bins(spark, d):
    return rounded(profile.bin_counts(B.table(spark, d, "customer"), "c_acctbal", -1000.0, 500.0))


@query("""SELECT l_suppkey, l_returnflag, count(*) AS n, any_value(c)::BIGINT AS per_supplier FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem) GROUP BY 1, 2""")
def match_counts(spark, d):
    own = B.table(spark, d, "lineitem").withColumn("c", profile.group_count(["l_suppkey"]))
    return own.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.first("c").alias("per_supplier"))


@query("""SELECT c_custkey AS id, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS cdf FROM customer""")
def balance_cdf(spark, d):
    return rounded(profile.cumulative_share(B.table(spark, d, "customer"), "c_acctbal", ["c_nationkey"], "cdf").select(F.col("c_custkey").alias("id"), "cdf"))


@query("""WITH d AS (SELECT p_type AS value, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM (SELECT DISTINCT p_type FROM part)) SELECT code AS p_type_code, count(*) AS n, sum(p_size)::BIGINT AS size FROM part JOIN d ON value = p_type GROUP BY 1""")
def dictionary_codes(spark, d):
    p = B.table(spark, d, "part").select("p_type", "p_size")
    return profile.encoded(p, "p_type", profile.dictionary(p, "p_type")).groupBy("p_type_code").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("""WITH n AS (SELECT s_nationkey AS area, s_suppkey % 5 AS type, count(*) AS n FROM supplier GROUP BY 1, 2), g AS (SELECT area, type FROM (SELECT DISTINCT area FROM n), (SELECT DISTINCT type FROM n))
SELECT area, type, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY area), 6) AS pct FROM g LEFT JOIN n USING (area, type)""")
def complete_type_grid(spark, d):
    n = B.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("area"), (F.col("s_suppkey") % 5).alias("type")).agg(F.count("*").alias("n"))
    return rounded(scenario.completed(n, ["area", "type"], {"n": 0}).withColumn("pct", vulnerability.share_of_group("n", ["area"])))


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def common_nations(spark, d):
    return profile.set_operation(B.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), B.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "intersect")


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'n/a' ELSE replace(format('{:,}', p_partkey * 1234), ' ', '') END AS v, p_brand || '  (' || p_type || ')' AS n FROM part)
SELECT lower(regexp_replace(regexp_replace(regexp_replace(n, '[^a-zA-Z0-9._]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')) AS name, count(*) AS rows, count(try_cast(replace(v, ',', '') AS DOUBLE)) AS numbers, sum(try_cast(replace(v, ',', '') AS DOUBLE)) AS total FROM t GROUP BY 1""")
def cleaned_numbers(spark, d):
    k = F.col("p_partkey")
    v = F.when(k % 7 == 0, "").when(k % 7 == 1, "n/a").otherwise(F.format_number(k * 1234, 0))
    own = B.table(spark, d, "part").select(v.alias("v"), F.concat("p_brand", F.lit("  ("), "p_type", F.lit(")")).alias("n"))
    number = text.clean_number(F.col("v"))
    return own.groupBy(text.safe_name(F.col("n")).alias("name")).agg(F.count("*").alias("rows"), F.count(number).alias("numbers"), F.sum(number).alias("total"))


@query("""SELECT pano, round(sum(share) / 6, 6) AS gvi FROM (SELECT l_orderkey % 500 AS pano, l_linenumber % 6 AS heading, sum(l_quantity) FILTER (l_partkey % 12 IN (8, 9)) / sum(l_quantity) AS share FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def green_view_index(spark, d):
    own = B.table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("pano"), (F.col("l_linenumber") % 6).alias("heading"), (F.col("l_partkey") % 12).alias("class_id"), F.col("l_quantity").alias("n_px"))
    return rounded(zonal.green_view_index(own, "pano", [8, 9]))


@query("""WITH m AS (SELECT o_orderdate::DATE AS day, 'E0' || (o_custkey % 12) AS geog, (['I00 Heart', 'j00 Lung', 'X60 Harm', 'C00 Other'])[1 + (o_orderkey % 4)::INT] || ':' || o_orderpriority AS cause, replace(format('{:,}', o_totalprice::BIGINT), ' ', '') AS value FROM orders),
t AS (SELECT DISTINCT geog, lower(split_part(cause, ' ', 1)) AS code, split_part(cause, ':', 2) AS name, replace(value, ',', '')::DOUBLE AS v FROM m WHERE year(day) = 1997 AND starts_with(geog, 'E01') AND regexp_matches(cause, '^(?i)(i00|j00|x60)'))
SELECT geog, name, sum(v) FILTER (code = 'i00') AS i00, sum(v) FILTER (code = 'j00') AS j00, sum(v) FILTER (code = 'x60') AS x60 FROM t GROUP BY 1, 2""")
def mortality_tidy(spark, d):
    """Filters by year, prefix and case-blind pattern, distinct rows, split names, numbers out of texts, one column a cause."""
    k = F.col("o_orderkey")
    names = F.get(F.array(*map(F.lit, ["I00 Heart", "j00 Lung", "X60 Harm", "C00 Other"])), (k % 4).cast("int"))
    m = B.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.concat(F.lit("E0"), F.col("o_custkey") % 12).alias("geog"), F.concat(names, F.lit(":"), "o_orderpriority").alias("cause"), F.format_number(F.rint("o_totalprice").cast("long"), 0).alias("value"))
    m = m.where((F.year("day") == 1997) & F.col("geog").startswith("E01") & F.col("cause").rlike("(?i)^(i00|j00|x60)"))
    parts = text.split_parts(F.col("cause"), ":", 2)
    t = m.select("geog", F.lower(F.split_part(parts[0], F.lit(" "), F.lit(1))).alias("code"), parts[1].alias("name"), text.clean_number(F.col("value")).alias("v")).distinct()
    return scenario.wide(t.groupBy("geog", "name", "code").agg(F.sum("v").alias("v")), ["geog", "name"], "code", ["v"], ["i00", "j00", "x60"])


@query("""WITH r AS (SELECT p_name AS taxon, max(p_size) AS risk FROM part WHERE p_size > 30 GROUP BY 1) SELECT p_partkey AS id, p_name AS taxon, risk FROM part LEFT JOIN r ON r.taxon = p_name""")
def trees_with_risk(spark, d):
    p = B.table(spark, d, "part")
    risk = p.where("p_size > 30").groupBy(F.col("p_name").alias("taxon")).agg(F.max("p_size").alias("risk"))
    return trees.with_risk(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("taxon")), risk, "taxon")


@query(f"""WITH {B.POINTS.split(', point_zones')[0].rstrip().removesuffix(',')}, g AS (SELECT unnest(range(0, 100)) AS col), h AS (SELECT unnest(range(0, 100)) AS "row")
SELECT "row"::INT AS "row", count(*) AS n, count(DISTINCT col) AS cols FROM points p JOIN g ON col BETWEEN floor(x - 2) AND floor(x + 2) JOIN h ON "row" BETWEEN floor(-(y + 2)) AND floor(-(y - 2)) GROUP BY 1""")
def touched_cells(spark, d):
    own = geometry.cells_touched(_squares(spark, d), "id", Grid(0.0, 0.0, 1.0, 1.0, 100, 100))
    return own.groupBy("row").agg(F.count("*").alias("n"), F.count_distinct("col").alias("cols"))


@query("""SELECT o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS level, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2""")
def csv_files_tagged(spark, d):
    """Orders written as CSV by status and priority, read again with tags out of the files' folders."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("level"))
    folder = f"{scratch(spark)}/csv"
    o.write.partitionBy("status", "level").option("header", True).csv(folder)
    rows = readers.csv_files(spark, folder, "key long", {"status": (r"status=(\w)", 1), "level": (r"level=(\w)", 1)}, "*.csv", by_path=True)
    return rows.groupBy("status", "level").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


from heatgrid.plans import source_queries  # noqa: E402, F401  (adds its queries)
