"""Queries of readers, sinks, names and joins: tables are written from the driver's, read back and summed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.functions import classify, text
from heatgrid.functions import health as H
from heatgrid.operators import geometry, grid, health, order, profile, stats, tiles, zonal
from heatgrid.plans import bridges as B
from heatgrid.plans.registry import SQL, query, rounded
from heatgrid.sources import readers, sinks


# ---- readers and sinks


@query("SELECT c_mktsegment AS cause, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY 1")
def tsv_lower_names(spark, d):
    folder = f"{sinks.scratch(spark)}/tsv"
    B.table(spark, d, "customer").select(F.col("c_mktsegment").alias("CAUSE"), F.col("c_acctbal").alias("Value")).write.option("sep", "\t").option("header", True).csv(folder)
    rows = readers.tsv(spark, folder)
    return rounded(rows.groupBy("cause").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("total")), 4)


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS unparsed, sum(event_id)::BIGINT AS ids, round(sum(value) FILTER (event_id % 10 <> 0), 4) AS total FROM events")
def csv_after_preamble(spark, d):
    """Events as files with four lines before the rows, some of whose values are no numbers."""
    e = B.table(spark, d, "events").select((F.col("user_id") % 4).alias("p"), (F.col("event_id") + 4).alias("i"), F.concat_ws(",", "event_id", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string"))).alias("value"))
    heads = e.select("p").distinct().select("p", F.posexplode(F.array(*map(F.lit, ["station file", "a, b, c", "", "id,temp"]))).alias("i", "value")).withColumn("i", F.col("i").cast("long"))
    folder = f"{sinks.scratch(spark)}/preamble"
    e.unionByName(heads).repartition("p").sortWithinPartitions("p", "i").select("p", "value").write.partitionBy("p").text(folder)
    rows = readers.csv_after_preamble(spark, f"{folder}/*/", {"id": "long", "temp": "double"}, 3)
    return rounded(rows.agg(F.count("*").alias("n"), F.count_if(F.col("temp").isNull()).alias("unparsed"), F.sum("id").alias("ids"), F.sum("temp").alias("total")), 4)


@query("""SELECT p_brand AS brand, count(*) AS n, sum(length(p_name || chr(10) || '"' || p_type || '", x'))::BIGINT AS chars FROM part GROUP BY 1""")
def multiline_values(spark, d):
    folder = f"{sinks.scratch(spark)}/multiline"
    note = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('", x'))
    B.table(spark, d, "part").select("p_brand", note.alias("note")).write.option("header", True).option("escape", '"').csv(folder)
    rows = readers.multiline_csv(spark, folder, "brand string, note string")
    return rows.groupBy("brand").agg(F.count("*").alias("n"), F.sum(F.length("note")).alias("chars"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def cached_layer(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    kept = sinks.parquet(o, f"{sinks.scratch(spark)}/layer", ["status"])
    return rounded(kept.groupBy("status").agg(F.count("*").alias("n"), F.sum("price").alias("total")), 2)


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def feature_columns(spark, d):
    return readers.features(spark, f"{d}/nation.parquet", ["n_regionkey"]).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))


def _layers(spark, d) -> str:
    """Two layers of cells as a cell table; unknown values are -9999."""
    own = B.cells(spark, d).select("row", "col", "t0", "t1").unpivot(["row", "col"], ["t0", "t1"], "layer", "value").na.fill(-9999.0, ["value"])
    folder = f"{sinks.scratch(spark)}/cells"
    sinks.parquet(own, folder, ["layer"])
    return folder


@query(f"""WITH {B.CELLS} SELECT "row", col, t0, t1, round(t1 - t0, 9) AS delta FROM cells""")
def aligned_layers(spark, d):
    """Layers read one by one with their nodata masked, joined cell by cell."""
    folder = _layers(spark, d)
    a, b = (readers.cells(spark, folder, [n], -9999.0).select("row", "col", F.col("value").alias(n)) for n in ("t0", "t1"))
    return health.delta_t(grid.aligned(a, b, B.GRID, B.GRID)).withColumn("delta", F.round("delta", 9))


@query(SQL["aligned_layers"])
def aligned_tiles(spark, d):
    """The same layers in tiles: a join a tile, the difference on whole arrays."""
    folder = _layers(spark, d)
    a, b = (tiles.to_tiles(readers.cells(spark, folder, [n], -9999.0).select("row", "col", F.col("value").alias(n)), [n]) for n in ("t0", "t1"))
    both = tiles.algebra(tiles.aligned(a, b, B.GRID, B.GRID), ["t0", "t1"], lambda x: {**x, "delta": x["t1"] - x["t0"]}, ["t0", "t1", "delta"])
    return tiles.to_cells(both, ["t0", "t1", "delta"]).withColumn("delta", F.round("delta", 9))


@query("""SELECT 'scenario' || (CASE o_custkey % 4 WHEN 0 THEN 510 WHEN 1 THEN 520 ELSE 41 END) AS scenario, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders
WHERE o_custkey % 4 IN (0, 1) AND NOT (o_orderkey % 3 = 2) GROUP BY 1""")
def files_by_tokens(spark, d):
    """Of files named by scenario and climate case those with wanted tokens and without unwanted ones; their rows."""
    k = F.col("o_custkey") % 4
    run = F.concat(F.lit("scenario"), F.when(k == 0, "510").when(k == 1, "520").otherwise("41"), F.lit("_"), F.get(F.array(*map(F.lit, ["22deg_2uhi", "25deg_5uhi", "28deg_2uhi"])), (F.col("o_orderkey") % 3).cast("int")))
    folder = f"{sinks.scratch(spark)}/runs"
    B.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), run.alias("run")).write.partitionBy("run").parquet(folder)
    files = readers.find_files(spark, folder, "*.parquet", ["scenario510", "scenario520"], ["28deg_2uhi"])
    tail = lambda c: F.regexp_extract(c, "(run=.*)$", 1)
    rows = spark.read.parquet(folder).select("key", "run", tail(F.col("_metadata.file_path")).alias("file"))
    rows = profile.members(rows, files.select(tail(F.col("path")).alias("file")), ["file"])
    return rows.groupBy(F.split_part("run", F.lit("_"), F.lit(1)).alias("scenario")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("""WITH r AS (SELECT n_name AS name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT * FROM r UNION ALL SELECT 'Total', sum(customers)::BIGINT, round(sum(balance), 2) FROM r""")
def csv_with_totals(spark, d):
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    own = rounded(B.table(spark, d, "customer").join(n, "c_nationkey").groupBy("name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")), 2)
    folder = f"{sinks.scratch(spark)}/totals"
    sinks.csv_with_totals(own, folder, "name", {"source": "customer", "run": "nations"})
    return rounded(spark.read.schema("name string, customers long, balance double").option("header", True).csv(folder), 2)


_FILED = [(n, rr * 1.01, lo, hi) for n, rr, lo, hi in H.CAUSES[:3]]


@query(f"""WITH {B.CELLS}, causes(cause, beta) AS (VALUES {", ".join(f"('{n}', ln({rr!r}::DOUBLE))" for n, rr, *_ in _FILED)})
SELECT cause, round(coalesce(sum(deaths / nullif(pop0, 0) * pop1), 0), 6) AS deaths, round(coalesce(sum(deaths / nullif(pop0, 0) * pop1 * (1 - exp(-beta * (t1 - t0)))), 0), 6) AS excess FROM cells, causes GROUP BY 1""")
def causes_from_file(spark, d):
    """City totals for causes that a settings file lists instead of the usual ones."""
    folder = f"{sinks.scratch(spark)}/causes"
    listed = json.dumps([dict(zip(("name", "rr_1c", "rr_low_1c", "rr_high_1c"), c, strict=True)) for c in _FILED])
    spark.range(1).select(F.lit(listed).alias("value")).coalesce(1).write.text(folder)
    causes = readers.causes(spark, folder).select(F.col("name").alias("cause"), F.ln("rr_1c").alias("beta"))
    return rounded(health.city_totals(health.with_excess(B.cells(spark, d), causes)).select("cause", "deaths", "excess"))


@query("SELECT c_nationkey::VARCHAR AS lat, count(*) AS n, sum(c_custkey)::BIGINT AS ids, 0::BIGINT AS with_date FROM customer GROUP BY 1")
def key_value_lines(spark, d):
    folder = f"{sinks.scratch(spark)}/lines"
    B.table(spark, d, "customer").select(F.concat(F.lit("panoID: "), "c_custkey", F.lit("  lat:"), "c_nationkey").alias("value")).write.text(folder)
    rows = readers.key_value_lines(spark, folder, ["panoID", "lat", "panoDate"])
    return rows.groupBy("lat").agg(F.count("*").alias("n"), F.sum(F.col("panoID").cast("long")).alias("ids"), F.count("panoDate").alias("with_date"))


@query("""SELECT user_id::VARCHAR AS pano_id, count(*) AS n, round(sum(value), 4) AS lat, round(sum(-value / 2), 4) AS lng, min('2024-' || lpad(month(ts)::VARCHAR, 2, '0')) AS first FROM events WHERE event_id % 3 = 0 GROUP BY 1""")
def image_metadata(spark, d):
    status = F.get(F.array(*map(F.lit, ["OK", "ZERO_RESULTS", "NOT_FOUND"])), (F.col("event_id") % 3).cast("int"))
    place = F.struct(F.col("value").alias("lat"), (-F.col("value") / 2).alias("lng"))
    body = F.struct(status.alias("status"), F.concat(F.lit("2024-"), F.date_format("ts", "MM")).alias("date"), F.col("user_id").cast("string").alias("pano_id"), place.alias("location"))
    own = readers.image_metadata(B.table(spark, d, "events").select(F.to_json(body).alias("json")))
    return rounded(own.groupBy("pano_id").agg(F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lng").alias("lng"), F.min("date").alias("first")), 4)


# ---- columns, rows and names


@query("SELECT c_nationkey, round(sum(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1")
def columns_by_pattern(spark, d):
    own = profile.select_matching(B.table(spark, d, "customer"), "^c_.*(key|bal)$", "cust")
    return rounded(own.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("c_acctbal")), 4)


@query("SELECT a.n_name, b.n_name AS n_name_1, a.n_regionkey FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25")
def repeated_names(spark, d):
    a = B.table(spark, d, "nation")
    b = a.select(F.col("n_name").alias("other"), F.pmod(F.col("n_nationkey") - 1, F.lit(25)).alias("n_nationkey"))
    return profile.unique_names(a.join(b, "n_nationkey").select("n_name", "other", "n_regionkey").toDF("n_name", "n_name", "n_regionkey"))


@query("SELECT o_orderpriority AS layer, least(count(*), 40) AS n, true AS inside FROM orders GROUP BY 1")
def sample_per_layer(spark, d):
    """At most 40 random rows of each layer, all of them rows of the table."""
    o = B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("layer"), "o_orderkey")
    drawn = profile.sample_per_layer(o, "layer", 40)
    return drawn.groupBy("layer").agg(F.count("*").alias("n"), (F.count_distinct("o_orderkey") == F.count("*")).alias("inside"))


@query("SELECT event_id AS fid_1, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts::DATE, '%Y-%m-%d') AS day, (value > 100)::TINYINT AS high, '[' || user_id || ',' || event_id || ']' AS ids FROM events")
def export_columns(spark, d):
    e = B.table(spark, d, "events")
    return profile.export_safe(e.select(F.col("event_id").alias("fid"), "ts", F.to_date("ts").alias("day"), (F.col("value") > 100).alias("high"), F.array("user_id", "event_id").alias("ids")))


@query("SELECT c_custkey AS id, c_nationkey AS area FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_customers(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area"))
    return profile.unmatched(c, B.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@query("SELECT s_suppkey AS id, s_nationkey AS area FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def member_suppliers(spark, d):
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("area"))
    return profile.members(s, B.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("area")), ["area"]).select("id", "area")


@query(f"""WITH {B.UNITS} SELECT id, row_number() OVER (ORDER BY m1 DESC NULLS LAST, m3, id) AS place, row_number() OVER (ORDER BY id DESC) AS row_id FROM units""")
def sorted_places(spark, d):
    """Places in a sort of mixed directions, nulls last, and row numbers."""
    u = B.units(spark, d).select("id", "m1", "m3")
    placed = order.with_places(u, [F.desc_nulls_last("m1"), F.asc("m3"), F.asc("id")])
    return profile.with_row_ids(placed, [F.desc("id")]).select("id", "place", "row_id")


@query(f"""WITH {B.POINTS.split(", point_zones")[0].rstrip().removesuffix(",")} SELECT id FROM points WHERE x + 2 >= 20 AND x - 2 <= 60 AND y + 2 >= -50 AND y - 2 <= -10 AND id % 5 <> 0""")
def features_in_extent(spark, d):
    p, k = B.points(spark, d), F.col("id") % 5 != 0
    boxes = p.select("id", *[F.when(k, c).alias(n) for n, c in (("xmin", F.col("x") - 2), ("xmax", F.col("x") + 2), ("ymin", F.col("y") - 2), ("ymax", F.col("y") + 2))])
    return geometry.in_extent(boxes, 20.0, -50.0, 60.0, -10.0).select("id")


_MODELS, _PATHS = ["UKESM1-0-LL", "MRI-ESM2", "CNRM"], ["ssp245_2041-2060", "historical_1981-2010", "ssp585"]


@query(r"""WITH f AS (SELECT 'tas_' || (['UKESM1-0-LL', 'MRI-ESM2', 'CNRM'])[1 + (p_partkey % 3)::INT] || '_' || (['ssp245_2041-2060', 'historical_1981-2010', 'ssp585'])[1 + p_size % 3] || '.csv' AS name,
  CASE WHEN p_size % 4 = 0 THEN 'stats.csv' ELSE '/x/scenario' || (p_size % 4) || (CASE WHEN p_partkey % 2 = 0 THEN '_10prc' ELSE '' END) || '_zonal_stats_mean.csv' END AS file FROM part)
SELECT nullif(regexp_extract(name, '_([A-Za-z0-9-]+)_(ssp\d+|historical)_(\d{4}-\d{4})', 1), '') AS model, nullif(regexp_extract(name, '_([A-Za-z0-9-]+)_(ssp\d+|historical)_(\d{4}-\d{4})', 2), '') AS pathway,
  nullif(regexp_extract(name, '_([A-Za-z0-9-]+)_(ssp\d+|historical)_(\d{4}-\d{4})', 3), '') AS period, coalesce(nullif(regexp_extract(file, '(scenario\d*(?:_[A-Za-z0-9]+)*)_zonal_stats_[^/]+\.csv$', 1), ''), 'scenario') AS scenario, count(*) AS n FROM f GROUP BY 1, 2, 3, 4""")
def file_name_parts(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("tas_"), F.get(F.array(*map(F.lit, _MODELS)), (k % 3).cast("int")), F.lit("_"), F.get(F.array(*map(F.lit, _PATHS)), z % 3), F.lit(".csv"))
    file = F.when(z % 4 == 0, "stats.csv").otherwise(F.concat(F.lit("/x/scenario"), z % 4, F.when(k % 2 == 0, "_10prc").otherwise(""), F.lit("_zonal_stats_mean.csv")))
    own = B.table(spark, d, "part").select(name.alias("name"), file.alias("file"))
    model, pathway, period = text.climate_file_parts(F.col("name"))
    return own.groupBy(model.alias("model"), pathway.alias("pathway"), period.alias("period"), text.zonal_scenario(F.col("file")).alias("scenario")).agg(F.count("*").alias("n"))


_SHORT = {
    "/runs/sc1/out/T_air_scenario_20.0deg_2.0uhi.tif": ("sc1_20_2", "sc1_20_2", "sc1_20_2", "sc1_20_2"),
    "/runs/sc1/out/T_scenario41_10prc_22deg_5.5uhi.tif": (None, "sc1_22_5", "sc1_22_5.5", "sc1"),
    "/runs/work/Scenario0/high_22.50DEG_x_2uhi.tif": (None, None, "Scenario0_22.5_2", "work"),
    "/else/folder/scenario_25deg_2uhi.tif": (None, None, "folder_25_2", "folder_25_2"),
    "/runs/sc2/other.tif": (None, None, None, "sc2"),
}


def _short_sql() -> str:
    text_ = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join(f"({i}, {', '.join(map(text_, v))})" for i, v in enumerate(_SHORT.values()))
    return f"WITH v(k, strict, suffix, named, lenient) AS (VALUES {rows}) SELECT strict, suffix, named, lenient, count(*) AS n FROM part JOIN v ON p_partkey % {len(_SHORT)} = k GROUP BY ALL"


@query(_short_sql())
def short_name_forms(spark, d):
    """Paths come again and again, so they are counted first and their forms found once for each different one."""
    path = F.get(F.array(*map(F.lit, _SHORT)), (F.col("p_partkey") % len(_SHORT)).cast("int"))
    forms = ("strict", "suffix", "named", "lenient")
    paths = B.table(spark, d, "part").groupBy(path.alias("path")).agg(F.count("*").alias("n"))
    own = paths.select("n", *[text.short_name(F.col("path"), "/runs", f).alias(f) for f in forms])
    return own.groupBy(*forms).agg(F.sum("n").alias("n"))


@query(f"""WITH {B.CELLS} SELECT CASE WHEN lc0 BETWEEN 1 AND 10 THEN lc0 ELSE 0 END AS code, count(*) AS n, count(CASE WHEN canopy BETWEEN 1 AND 30 THEN canopy END) AS canopy_known FROM cells GROUP BY 1""")
def value_masks(spark, d):
    own = B.cells(spark, d).select(classify.mask_outside(F.col("lc0"), 1, 10, 0).alias("code"), classify.mask_outside(F.col("canopy"), 1, 30).alias("canopy"))
    return own.groupBy("code").agg(F.count("*").alias("n"), F.count("canopy").alias("canopy_known"))


@query("""WITH n AS (SELECT c_nationkey AS area, c_mktsegment AS use, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2) SELECT area, arg_max(use, (n, -first)) AS use FROM n GROUP BY 1""")
def mode_first_seen(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("use"), F.col("c_custkey").alias("at"))
    return zonal.mode_first(c, ["area"], "use", "at")


@query("""SELECT (o_orderkey % 400)::INT AS "row", (o_custkey % 7)::INT AS col, arg_max(o_orderkey, o_orderkey) AS zone FROM orders GROUP BY 1, 2""")
def overlapping_zones(spark, d):
    own = B.table(spark, d, "orders").select((F.col("o_orderkey") % 400).cast("int").alias("row"), (F.col("o_custkey") % 7).cast("int").alias("col"), F.col("o_orderkey").alias("zone"), F.col("o_orderkey").alias("at"))
    return geometry.later_wins(own, "zone", "at")


# ---- tails of tests; SQL has none, brute force is in the tests


@query()
def slope_intervals(spark, d) -> DataFrame:
    m = B.units(spark, d).unpivot(["id", "population"], ["m1", "m2", "m4"], "metric", "value")
    return rounded(stats.with_slope_interval(stats.ols(m, x="value", y="population")))


@query()
def test_p_values(spark, d) -> DataFrame:
    """p-values of the analysis of variance, of the rank tests and of correlations."""
    long = B.scenario_long(spark, d)
    tied = long.select(F.col("lc_scenario").alias("g"), F.round("value").cast("long").alias("v"))
    f = stats.anova(long, "year", "value")
    k = stats.kruskal(tied, "g", "v")
    w = stats.rank_sum(tied, "g", "v")
    r = stats.correlations(B.units(spark, d), ["m1", "m2", "m4"])
    name = lambda *parts: F.concat_ws(" ", *parts).alias("test")
    rows = f.select(name(F.lit("anova")), stats.f_p_value(F.col("f"), F.col("df1"), F.col("df2")).alias("p"))
    rows = rows.union(k.select(name(F.lit("kruskal")), stats.chi2_p_value(F.col("h"), F.col("df")).alias("p")))
    rows = rows.union(w.select(name(F.lit("ranksum"), "g_a", "g_b"), stats.z_p_value(F.col("z")).alias("p")))
    rows = rows.union(r.select(name(F.lit("correlation"), "a", "b"), stats.t_p_value(stats.correlation_t(F.col("r"), F.col("n")), F.col("n") - 2).alias("p")))
    return rounded(rows, 9)
