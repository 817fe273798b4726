"""Views of the driver's tables in the shapes of the domain, in Spark and, for the oracle, as SQL table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.operators.grid import Grid

#: 100 columns; y grows upwards in the views, so the grid hangs from y = 0 with rows that go down from it.
GRID = Grid(0.0, 0.0, 1.0, 1.0, 10**9, 100)
#: Standard-normal quantiles for draws that are the same everywhere.
QUANTILES = [-1.959964, -1.281552, -0.674490, -0.253347, 0.0, 0.253347, 0.674490, 1.281552, 1.959964]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    t0, lc0 = 18 + price / 100000, (c % 22).cast("int")
    return o.select(
        F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"), t0.alias("t0"), F.when(k % 97 != 0, t0 + (c % 7 - 2) * 0.5).alias("t1"), lc0.alias("lc0"),
        F.when((c % 5 == 0) & (lc0 != 0), 100).otherwise(lc0).alias("lc1"), F.when(c % 11 != 0, (c % 37).cast("double")).alias("canopy"), F.when(c % 3 == 0, 2050).when(c % 3 == 1, 2070).alias("risk_year"),
        (c % 50).cast("double").alias("pop0"), (c % 50 + k % 5).cast("double").alias("pop1"), (price / 100000).alias("deaths"),
    )


CELLS = """cells AS (SELECT (o_orderkey // 100)::INT AS "row", (o_orderkey % 100)::INT AS col, 18 + o_totalprice / 100000 AS t0,
  CASE WHEN o_orderkey % 97 <> 0 THEN 18 + o_totalprice / 100000 + (o_custkey % 7 - 2) * 0.5::DOUBLE END AS t1, (o_custkey % 22)::INT AS lc0,
  CASE WHEN o_custkey % 5 = 0 AND o_custkey % 22 <> 0 THEN 100 ELSE (o_custkey % 22)::INT END AS lc1, CASE WHEN o_custkey % 11 <> 0 THEN (o_custkey % 37)::DOUBLE END AS canopy,
  CASE o_custkey % 3 WHEN 0 THEN 2050 WHEN 1 THEN 2070 END AS risk_year, (o_custkey % 50)::DOUBLE AS pop0, (o_custkey % 50 + o_orderkey % 5)::DOUBLE AS pop1, o_totalprice / 100000 AS deaths FROM orders)"""


def _corners() -> list[tuple[Column, Column]]:
    k = F.col("n_nationkey")
    x, y = (k % 5) * 20.0, F.floor(k / 5) * 20.0
    return [(x + 0.25, y + 0.3), (x + 19.4 - k % 3, y + 0.8), (x + 19.7, y + 19.45), (x + 0.55 + k % 4, y + 19.65)]


def zones(spark: SparkSession, d: str) -> DataFrame:
    """25 quadrilaterals; y is minus the row."""
    ring = F.array(*[F.struct(x.cast("double").alias("x"), (-y).cast("double").alias("y")) for x, y in reversed(_corners())])
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.array(ring).alias("rings"))


ZONES = """corners AS (SELECT n_nationkey AS zone, n_regionkey AS region, [{'x': (n_nationkey % 5) * 20.0 + 0.25, 'y': -((n_nationkey // 5) * 20.0 + 0.3)}, {'x': (n_nationkey % 5) * 20.0 + 19.4 - n_nationkey % 3, 'y': -((n_nationkey // 5) * 20.0 + 0.8)},
  {'x': (n_nationkey % 5) * 20.0 + 19.7, 'y': -((n_nationkey // 5) * 20.0 + 19.45)}, {'x': (n_nationkey % 5) * 20.0 + 0.55 + n_nationkey % 4, 'y': -((n_nationkey // 5) * 20.0 + 19.65)}]::STRUCT(x DOUBLE, y DOUBLE)[] AS ring FROM nation),
edges AS (SELECT zone, ring[i].x AS x1, ring[i].y AS y1, ring[i % 4 + 1].x AS x2, ring[i % 4 + 1].y AS y2 FROM corners, range(1, 5) AS t(i)),
zone_cells AS (SELECT zone, "row", col FROM (SELECT e.zone, c."row", c.col, count(*) FILTER ((y1 > -(c."row" + 0.5::DOUBLE)) <> (y2 > -(c."row" + 0.5::DOUBLE)) AND c.col + 0.5::DOUBLE < (x2 - x1) * (-(c."row" + 0.5::DOUBLE) - y1) / (y2 - y1) + x1) AS n
  FROM cells c JOIN edges e ON true GROUP BY 1, 2, 3) WHERE n % 2 = 1)"""


#: Rings of a zone of several parts, by places right of and below its corner: an outer ring, a hole, an island in it, a part apart and one that is too small.
_RINGS = {
    "outer": [(0.25, 0.3), (19.4, 0.8), (19.7, 19.45), (0.55, 19.65)], "hole": [(6, 6), (6, 12.5), (12, 12), (12, 6)], "island": [(8, 8), (10.3, 8), (10, 10), (8, 10)],
    "apart": [(2, 22), (10, 22.5), (2.5, 32)], "small": [(15, 25), (15.6, 25), (15.6, 25.6), (15, 25.5)],
}


def part_zones(spark: SparkSession, d: str) -> DataFrame:
    """25 zones of four parts; their rings come in other orders and directions from zone to zone."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 20.0, F.floor(k / 5) * 40.0
    rings = []
    for i, ring in enumerate(_RINGS.values()):
        own = F.array(*[F.struct((x + dx).cast("double").alias("x"), (-(y + dy)).cast("double").alias("y")) for dx, dy in ring])
        rings.append(F.struct(((k + i) % 5).alias("place"), F.when((k + i) % 2 == 0, own).otherwise(F.reverse(own)).alias("r")))
    return table(spark, d, "nation").select(k.alias("zone"), F.transform(F.array_sort(F.array(*rings)), lambda r: r["r"]).alias("rings"))


_SQL_RINGS = " UNION ALL ".join(f"SELECT zone, '{name}' AS ring, [{', '.join(f'[x + {dx}, y + {dy}]' for dx, dy in ring)}]::DOUBLE[][] AS p FROM corner" for name, ring in _RINGS.items())
PARTS = f"""corner AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * 20.0 AS x, (n_nationkey // 5) * 40.0 AS y FROM nation), rings AS ({_SQL_RINGS}),
edges AS (SELECT zone, ring, p[i][1] AS x1, -p[i][2] AS y1, p[i % len(p) + 1][1] AS x2, -p[i % len(p) + 1][2] AS y2 FROM rings, range(1, 5) AS t(i) WHERE i <= len(p))"""


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), ((k * 37 % 1000) / 10 + 0.03).alias("x"), (-((k * 91 % 1000) / 10 + 0.07)).alias("y"), F.when(k % 9 != 0, F.col("c_mktsegment")).otherwise(" ").alias("use"), F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("nation")
    )


POINTS = """points AS (SELECT c_custkey AS id, (c_custkey * 37 % 1000) / 10 + 0.03::DOUBLE AS x, -((c_custkey * 91 % 1000) / 10 + 0.07::DOUBLE) AS y,
  CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment ELSE ' ' END AS use, c_acctbal AS value, c_nationkey AS nation FROM customer),
point_zones AS (SELECT id, zone FROM (SELECT p.id, e.zone, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) AS n FROM points p JOIN edges e ON true GROUP BY 1, 2) WHERE n % 2 = 1)"""


def scenario_long(spark: SparkSession, d: str) -> DataFrame:
    """A value per supplier, year and scenario: N is the baseline."""
    own = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("lc_scenario"), F.col("l_extendedprice").alias("v"))
    return own.groupBy("unit", "year", "lc_scenario").agg((F.sum(F.round(F.col("v") * 100).cast("long")) / 1e6).alias("value"))


LONG = """long AS (SELECT l_suppkey AS unit, year(l_shipdate)::INT AS year, l_returnflag AS lc_scenario, sum(round(l_extendedprice * 100)::BIGINT) / 1e6 AS value FROM lineitem GROUP BY 1, 2, 3)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    """Areas with vulnerability metrics, ties and nulls among them."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("area"), F.when(k % 13 != 0, b).alias("m1"), (k * 7 % 101).cast("double").alias("m2"), (k % 4).cast("double").alias("m3"), (b * b / 1e6 + k % 17).alias("m4"), (k % 900 + 100).cast("double").alias("population"),
    )


UNITS = """units AS (SELECT c_custkey AS id, c_nationkey AS area, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS m1, (c_custkey * 7 % 101)::DOUBLE AS m2, (c_custkey % 4)::DOUBLE AS m3,
  c_acctbal * c_acctbal / 1e6 + c_custkey % 17 AS m4, (c_custkey % 900 + 100)::DOUBLE AS population FROM customer)"""


def paired_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of each unit in two scenarios; some units lack one."""
    u = units(spark, d)
    k, base = F.col("id"), F.col("m2") / 10 + F.col("id") % 23
    a = u.select("*", F.lit("Green30").alias("lc_scenario"), base.alias("cases")).where(k % 29 != 0)
    return a.union(u.select("*", F.lit("Target30").alias("lc_scenario"), (base * 0.75 + k % 7).alias("cases")).where(k % 31 != 0))


PAIRED = """pairs AS (SELECT *, m2 / 10 + id % 23 AS cases_first, (m2 / 10 + id % 23) * 0.75 + id % 7 AS cases_second FROM units WHERE id % 29 <> 0 AND id % 31 <> 0),
cuts AS (SELECT quantile_cont(cases_first, 1/3::DOUBLE) AS a, quantile_cont(cases_first, 2/3::DOUBLE) AS b FROM pairs),
classed AS (SELECT pairs.*, cases_second - cases_first AS delta_cases, CASE WHEN cases_first <= a THEN 'Low' WHEN cases_first <= b THEN 'Moderate' ELSE 'High' END AS benefit_first,
  CASE WHEN cases_second <= a THEN 'Low' WHEN cases_second <= b THEN 'Moderate' ELSE 'High' END AS benefit_second FROM pairs, cuts),
vuln AS (SELECT *, percent_rank() OVER (PARTITION BY metric ORDER BY vulnerability) >= 2/3::DOUBLE AS high FROM (SELECT id, 'm1' AS metric, m1 AS vulnerability, * EXCLUDE (id, m1, m2, m3, m4) FROM classed
  UNION ALL SELECT id, 'm2', m2, * EXCLUDE (id, m1, m2, m3, m4) FROM classed UNION ALL SELECT id, 'm3', m3, * EXCLUDE (id, m1, m2, m3, m4) FROM classed) WHERE vulnerability IS NOT NULL)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("station"), F.col("ts"), F.col("value").alias("temperature"))


OBS = "obs AS (SELECT user_id AS station, ts, value AS temperature FROM events)"


def trees(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), (k * 7919 % 2003).alias("rank"), ((k * 53 % 1000) / 10 + 0.01).alias("x"), (-((k * 17 % 150) + 0.02)).cast("double").alias("y"), F.col("p_name").alias("TaxonName"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


TREES = """trees AS (SELECT p_partkey AS id, p_partkey * 7919 % 2003 AS rank, (p_partkey * 53 % 1000) / 10 + 0.01::DOUBLE AS x, -((p_partkey * 17 % 150) + 0.02::DOUBLE) AS y, p_name AS "TaxonName", p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price FROM part)"""
