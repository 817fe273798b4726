"""Dated intervals against all pairs, also where one key has all of them; Monte Carlo sums against the formula cell by cell."""

import datetime
import math
import random

import numpy as np
import pytest
from heatgrid.operators import health, observations

DAY = datetime.date(1970, 1, 1)


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def brute(events, intervals):
    out = []
    for k, at, label in events:
        held = [(s, e, name) for key, s, e, name in intervals if key == k and k is not None and None not in (at, s, e) and s <= at <= e]
        best = max((s for s, _, _ in held), default=None)
        out += [(k, day(at), label, day(s), day(e), name, at - s) for s, e, name in held if s == best]
    return sorted(out, key=str)


def tables(spark, events, intervals):
    e = spark.createDataFrame([(k, day(a), label) for k, a, label in events], "k int, at date, label int")
    i = spark.createDataFrame([(k, day(s), day(t), name) for k, s, t, name in intervals], "k int, start date, stop date, name int")
    return e, i


@pytest.mark.parametrize(("span", "longest"), [(40, 12), (4000, 900), (200_000, 150_000)])
def test_intervals_against_all_pairs(spark, span, longest):
    r = random.Random(span)
    draw = lambda: r.choice([None, r.randint(-span, span)]) if r.random() < 0.1 else r.randint(-span, span)
    events = [(r.choice([1, 1, 2, 3, None]), draw(), i) for i in range(120)]
    intervals = [(r.choice([1, 1, 2, 4, None]), s, None if s is None else s + r.choice([-1, 0, 1, 7, 8, r.randint(0, longest)]), i) for i, s in ((i, draw()) for i in range(120))]
    events += events[:5]
    intervals += [(1, 3, 3 + longest, 900), (1, 3, 4 + longest, 901), (1, 3, 3 + longest, 900)]
    e, i = tables(spark, events, intervals)
    got = sorted((tuple(x) for x in observations.interval_nearest(e, i, "k", "at", "start", "stop").collect()), key=str)
    assert got == brute(events, intervals) and len(got) > 20


def test_blocks_make_up_an_interval(spark):
    from pyspark.sql import functions as F

    cases = [(a, b) for a in range(0, 70, 3) for b in range(a + 1, 75)] + [(1, 1 << 20), (5, 3_000_001), (1 << 21, (1 << 21) + 400)]
    df = spark.createDataFrame(cases, "a long, b long")
    for r in df.select("a", "b", observations._blocks(F.col("a"), F.col("b")).alias("own")).collect():
        spans = sorted((x.number << x.size, (x.number + 1) << x.size) for x in r.own)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(p[1] == q[0] for p, q in zip(spans, spans[1:], strict=False))
        assert len(spans) <= 2 * max(1, math.ceil(math.log2(r.b - r.a + 1)))


def test_one_key_with_all_events_and_intervals(spark):
    """100,000 of each that all overlap would be 10^10 pairs."""
    n = 100_000
    events = spark.range(n).selectExpr("1 AS k", "date_add(DATE'2000-01-01', CAST(id % 5000 AS INT)) AS at", "id AS event")
    intervals = spark.range(n).selectExpr("1 AS k", "date_add(DATE'1999-01-01', CAST(id % 7000 AS INT)) AS start", "date_add(DATE'2019-01-01', CAST(id % 100 AS INT)) AS stop", "id AS name").where("id % 7000 > 6900 OR id < 7000")
    got = observations.interval_nearest(events, intervals, "k", "at", "start", "stop")
    assert got.where("days = 0").groupBy("event").count().count() == n


def test_intervals_are_not_broadcast(spark):
    """An interval has several blocks, which estimates of a table's size do not know: only the sizes of blocks are broadcast."""
    events = spark.range(50).selectExpr("id % 5 AS k", "date_add(DATE'2000-01-01', CAST(id AS INT)) AS at")
    intervals = spark.range(50).selectExpr("id % 5 AS k", "date_add(DATE'1999-12-01', CAST(id AS INT)) AS start", "date_add(DATE'2001-01-01', CAST(id AS INT)) AS stop")
    got = observations.interval_nearest(events, intervals, "k", "at", "start", "stop")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 3
    assert got.count() == 50


def test_draw_sums_equal_the_formula(spark):
    r = random.Random(3)
    rows = [(18.0 + r.random(), r.choice([None, 18.0 + 5 * r.random(), 20.0]), r.choice([0.0, 10.0, None, 50.0]), r.choice([12.0, None]), r.choice([0.5, 1.0, None])) for _ in range(5000)]
    cells = spark.createDataFrame(rows, "t0 double, t1 double, pop0 double, pop1 double, deaths double").repartition(7)
    draws = health.normal_draws(health.causes(spark), [-1.5, 0.0, 0.3, 2.0])
    want = {}
    for d in draws.collect():
        total = 0.0
        for t0, t1, p0, p1, deaths in rows:
            if None not in (t1, p0, p1, deaths) and p0 > 0:
                total += deaths / p0 * p1 * -math.expm1(-d.beta * (t1 - t0))
        want[d.cause, d.draw] = total
    got = {(x.cause, x.draw): x.excess for x in health.draw_totals(cells, draws).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert health.draw_totals(cells.limit(0), draws).count() == 0
    none = health.draw_totals(cells.where("t1 IS NULL"), draws).collect()
    assert len(none) == len(want) and all(x.excess == 0 for x in none)


def test_draws_shuffle_a_row_a_task_and_cause(spark):
    """Every cell has its own temperature change: what is shuffled does not follow the cells."""
    r = np.random.default_rng(1)
    rows = [(18.0, float(x), 10.0, 10.0, 1.0) for x in 18 + 3 * r.random(3000)]
    cells = spark.createDataFrame(rows, "t0 double, t1 double, pop0 double, pop1 double, deaths double").repartition(6)
    draws = health.random_draws(health.causes(spark), 100)
    plan = health.draw_totals(cells, draws)
    assert plan.count() == 100 * health.causes(spark).count()
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("MapInArrow") > text.index("Aggregate") and "Cross" not in text
