"""Order statistics and rank tests on tables whose columns have the operators' own words for names, and against enumeration."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from heatgrid.operators import grid, order, profile, scenario, stats, vulnerability
from pyspark.sql import functions as F

WORDS = ["n", "before", "smaller", "ties"]
VALUES = [5.0, 7.0, 7.0, None, 9.0, 1.0, 12.0]


def named(spark, value, key="g"):
    return spark.createDataFrame([(k, v, i) for k in ("x", "y") for i, v in enumerate(VALUES)], f"`{key}` string, `{value}` double, id int")


@pytest.mark.parametrize("name", WORDS)
def test_names_of_values(spark, name):
    df = named(spark, name)
    known = sorted(v for v in VALUES if v is not None)
    want = {p: float(np.quantile(known, p)) for p in (0.25, 0.5, 0.75)}
    for r in scenario.quantiles(df, ["g"], name).collect():
        assert (r.p25, r.p50, r.p75) == (want[0.25], want[0.5], want[0.75])
    for r in scenario.box_stats(df, ["g"], name).collect():
        assert r.p50 == want[0.5] and r.upper == pytest.approx(want[0.75] + 1.5 * (want[0.75] - want[0.25]))
    got = grid.profile(df.where("g = 'x'"), name).first()
    assert got.p50 == want[0.5] and got["n"] == len(known) and got["mean"] == pytest.approx(np.mean(known))
    ranked = {r.id: (r.p, r.d) for r in order.with_ranks(df, name, ["g"], "p", "d").where("g = 'y'").collect()}
    assert ranked == {i: (None, None) if v is None else (sum(x < v for x in known) / (len(known) - 1), 1 + len({x for x in known if x > v})) for i, v in enumerate(VALUES)}
    bins = {r.id: r.q for r in vulnerability.quantile_bin(df.where("g = 'x'"), name, 2, "q").collect()}
    assert bins == {i: None if v is None else 1 + (v > want[0.5]) for i, v in enumerate(VALUES)}


@pytest.mark.parametrize("name", WORDS)
def test_names_of_values_in_rank_tests(spark, name):
    rows = [(g, float(v)) for g, vs in {"a": [1, 2, 2, 8], "b": [3, 4, 9], "c": [5, 2, 7, 7]}.items() for v in vs]
    df, plain = spark.createDataFrame(rows, f"g string, `{name}` double"), spark.createDataFrame(rows, "g string, v double")
    assert stats.kruskal(df, "g", name).first() == stats.kruskal(plain, "g", "v").first()
    for test in (stats.rank_sum, stats.dunn):
        assert sorted(map(tuple, test(df, "g", name).collect())) == sorted(map(tuple, test(plain, "g", "v").collect()))


@pytest.mark.parametrize("name", WORDS)
def test_names_of_keys(spark, name):
    value = "v" if name != "v" else "w"
    df = named(spark, value, name)
    assert {r[name]: r.p50 for r in scenario.quantiles(df, [name], value).collect()} == {"x": 7.0, "y": 7.0}
    assert order.with_ranks(df, value, [name], "__p").where("__p = 1").count() == 2
    placed = order.with_places(df, [value, "id"], [name], out="place")
    assert sorted(r.place for r in placed.where(F.col(name) == "x").collect()) == list(range(1, 8))


def test_taken_names_are_refused(spark):
    df = named(spark, "v").withColumn("Place", F.lit(1))
    for call in (lambda: order.with_places(df, ["v", "id"]), lambda: order.with_ranks(df, "v", percent="ID"), lambda: order.running(df, ["v", "id"], out="g")):
        with pytest.raises(ValueError, match="already"):
            call()


@pytest.mark.parametrize("kind", ["double", "int", "string", "date", "decimal(10,2)"])
def test_kinds_of_values(spark, kind):
    r = random.Random(4)
    raw = [r.randint(0, 40) for _ in range(300)]
    column = {"string": F.format_string("%03d", "x"), "date": F.date_add(F.lit("2020-01-01"), F.col("x"))}.get(kind, F.col("x").cast(kind))
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(raw)], "g int, x int").select("g", "x", column.alias("v"))
    for x in order.counted(df, "v", ["g"]).join(df.distinct(), ["g", "v"]).collect():
        own = [v for i, v in enumerate(raw) if i % 3 == x.g]
        assert (x["__n"], x["__before"], x["__smaller"], x["__total"], x["__different"]) == (own.count(x.x), sum(v < x.x for v in own), len({v for v in own if v < x.x}), len(own), len(set(own)))


def test_values_of_very_many_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(order, "HOT_ROWS", 50)
    df = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r.id: r.p for r in order.with_ranks(df, "v", percent="p").collect()}
    want = {r.id: r.p for r in profile.cumulative_share(df, "v", [], "p").collect()}
    values = sorted(0.0 if i % 3 == 0 else float(i) for i in range(600))
    assert got == want and all(p == values.index(0.0 if i % 3 == 0 else float(i)) / 599 for i, p in got.items())


def test_bins_of_several_values_in_one_pass(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(10)]), r.choice([0, 0, 0, 1, 5]), r.random()) for i in range(400)]
    df = spark.createDataFrame([(a, None if b is None else float(b), float(c), d) for a, b, c, d in rows], "id int, a double, b double, c double")
    got = {x.id: (x.qa, x.qb, x.few, x.qc) for x in vulnerability.quantile_bins(df, {"qa": ("a", True), "qb": ("b", True), "few": ("b", False), "qc": ("c", True)}, 5).collect()}

    def bins(values, fallback):
        known = [v for v in values if v is not None]
        edges = sorted(set(np.quantile(known, [i / 5 for i in range(6)]).tolist()))
        if fallback and len(edges) < 6:
            return [None if v is None else max(1, math.ceil(round(5 * sum(x < v for x in known) / (len(known) - 1), 9))) for v in values]
        return [None if v is None else max(1, sum(e < v for e in edges)) for v in values]

    a, b, c = ([row[k] for row in rows] for k in (1, 2, 3))
    assert list(zip(bins(a, True), bins(b, True), bins(b, False), bins(c, True), strict=True)) == [got[i] for i in range(400)]


# ---- exact distribution of the rank sum


def enumerated(x, y):
    """Two-sided p by all ways to choose which of the ranks are the first group's."""
    every = sorted(x + y)
    w = sum(every.index(v) + 1 for v in x) - len(x) * (len(x) + 1) / 2
    sums = [sum(c) - len(x) * (len(x) + 1) / 2 for c in combinations(range(1, len(every) + 1), len(x))]
    low, high = sum(s <= w for s in sums) / len(sums), sum(s >= w for s in sums) / len(sums)
    return min(1.0, 2 * (high if w > len(x) * len(y) / 2 else low))


@pytest.mark.parametrize("n", range(1, 9))
def test_exact_p_equals_enumeration(n):
    r = random.Random(n)
    for m in range(1, 9):
        counts = stats.rank_sum_counts(n, m)
        assert counts.sum() == math.comb(n + m, n) and counts.tolist() == counts[::-1].tolist()
        values = r.sample(range(1000), n + m)
        x, y = values[:n], values[n:]
        w = sum(a > b for a in x for b in y)
        assert stats.exact_rank_sum_p(w, n, m) == pytest.approx(enumerated(x, y), abs=1e-12)


def test_large_groups_and_ties_are_normal(spark):
    r = random.Random(1)
    rows = [("a", r.random()) for _ in range(49)] + [("b", r.random()) for _ in range(49)] + [("c", r.random()) for _ in range(50)] + [("d", 0.5)] * 2
    own = stats.rank_sum(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    got = {(x.g_a, x.g_b): x for x in own.withColumn("p", stats.rank_sum_p_value(own)).withColumn("normal", stats.z_p_value(F.col("z"))).collect()}
    assert got["a", "b"].p == pytest.approx(stats.exact_rank_sum_p(got["a", "b"].w, 49, 49)) and got["a", "b"].p != got["a", "b"].normal
    assert got["a", "b"].p == pytest.approx(got["a", "b"].normal, abs=0.01)
    assert got["a", "c"].p == got["a", "c"].normal and got["a", "d"].tied and got["a", "d"].p == got["a", "d"].normal


def test_rank_sum_has_no_nested_loop(spark):
    df = spark.createDataFrame([(g, h, float(i)) for i, (g, h) in enumerate(zip("abcabc", "xxyyxy", strict=True))], "g string, h string, v double")
    plan = stats.rank_sum(df, "g", "v", ["h"])._jdf.queryExecution().executedPlan().toString()
    loops = [x for x in plan.splitlines() if "NestedLoop" in x or "Cartesian" in x]
    assert not any("OR" in x or "__group" in x for x in loops)  # but for the one row of range ends, without a condition


@pytest.mark.parametrize("at_once", [5, 40, 200_000])
def test_rank_sum_against_all_pairs_of_values(spark, monkeypatch, at_once):
    """Chunks of few rows, values that many share, nulls, not-a-numbers, groups apart."""
    monkeypatch.setattr(stats, "RANKED_AT_ONCE", at_once)
    r = random.Random(at_once)
    draw = lambda g: None if r.random() < 0.05 else float("nan") if r.random() < 0.05 else r.choice([r.randint(0, 9), r.random() * 9, 4]) + (100.0 if g == "high" else 0.0)
    rows = [(h, g, draw(g)) for h in ("x", "y", None) for g in ("a", "b", "c", "high", None) for _ in range(r.randint(5, 40))] + [("z", "only", 1.0)]
    df = spark.createDataFrame(rows, "h string, g string, v double")
    rank = lambda v: math.inf if math.isnan(v) else v
    for by in (["h"], []):
        got = {(x[0] if by else None, x.g_a, x.g_b): x for x in stats.rank_sum(df, "g", "v", by).collect()}
        want = 0
        for h in ("x", "y", "z") if by else (None,):
            of = {}
            for k, g, v in rows:
                if g is not None and v is not None and (not by or k == h):
                    of.setdefault(g, []).append(rank(v))
            for a, b in combinations(sorted(of), 2):
                want += 1
                x, y, own = of[a], of[b], got[h, a, b]
                w = sum((p > q) + (p == q) / 2 for p in x for q in y)
                n, ties = len(x) + len(y), sum(c**3 - c for c in Counter(x + y).values())
                sigma = math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
                off = w - len(x) * len(y) / 2
                assert (own.w, own.n_a, own.n_b, own.tied) == (w, len(x), len(y), ties > 0)
                assert own.z == pytest.approx((off - math.copysign(0.5, off) * (off != 0)) / sigma)
        assert len(got) == want


def test_rank_sum_does_not_repeat_values_for_pairs(spark, tmp_path):
    """Thirty groups are in 435 pairs: what is written and read on the way are the values once."""
    df = spark.range(3000).selectExpr("id % 30 AS g", "CAST(id * 7919 % 3001 AS DOUBLE) AS v")
    written = []
    keep = stats.order.parquet
    stats.order.parquet = lambda df, path: (written.append(keep(df, path)), written[-1])[1]
    try:
        assert stats.rank_sum(df, "g", "v").count() == 435
    finally:
        stats.order.parquet = keep
    assert max(x.count() for x in written) <= 3000


# ---- letters


def covers(names, differ):
    """All maximal sets of groups that do not differ from each other."""
    fine = [set(c) for k in range(1, len(names) + 1) for c in combinations(names, k) if not any((x, y) in differ for x, y in combinations(sorted(c), 2))]
    return {frozenset(c) for c in fine if not any(c < d for d in fine)}


def test_letters_against_all_covers():
    r = random.Random(6)
    for _ in range(300):
        names = [f"g{i}" for i in range(r.randint(2, 6))]
        differ = {p for p in combinations(names, 2) if r.random() < 0.5}
        got = stats.compact_letters([(a, b, (a, b) in differ) for a, b in combinations(names, 2)])
        sets = {}
        for name, letters in got.items():
            for x in letters:
                sets.setdefault(x, set()).add(name)
        assert {frozenset(s) for s in sets.values()} == covers(names, differ)
        assert list(sets) == sorted(sets) and all(got.values())
        for a, b in combinations(names, 2):
            assert bool(set(got[a]) & set(got[b])) == ((a, b) not in differ)


def test_letters_of_a_published_example(spark):
    """Groups in a row that overlap: T1 T2 | T2 T3 | T4."""
    p = {("T1", "T2"): 0.4, ("T1", "T3"): 0.01, ("T1", "T4"): 0.001, ("T2", "T3"): 0.2, ("T2", "T4"): 0.002, ("T3", "T4"): 0.03}
    rows = [("m", a, b, v) for (a, b), v in p.items()] + [("k", a, b, None) for a, b in p]
    df = spark.createDataFrame(rows, "metric string, g_a string, g_b string, p double")
    got = {(r.metric, r.g): r.letters for r in stats.letter_display(df, "g", by=["metric"]).collect()}
    assert [got["m", f"T{i}"] for i in range(1, 5)] == ["a", "ab", "b", "c"]
    assert {got["k", f"T{i}"] for i in range(1, 5)} == {"a"}
    assert stats.letter_display(df.limit(0), "g", by=["metric"]).count() == 0
