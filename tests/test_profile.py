"""Frequent values from bounded counters against the whole count; refusals."""

import random
from collections import Counter

import pytest
from heatgrid.operators import profile, scenario


def whole(rows, at, k):
    n = Counter(None if r[at] is None else str(r[at]) for r in rows)
    return [(v, c, i) for i, (v, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k], 1)]


def table(spark):
    r = random.Random(2)
    zipf = [int(1 / (r.random() ** 1.3 + 1e-6)) for _ in range(6000)]
    rows = [(i, z, r.choice(["a", "b", None, "c"]), "one", r.choice(range(40)), None) for i, z in enumerate(zipf)]
    return rows, spark.createDataFrame(rows, "key int, zipf int, few string, same string, `flat.x` int, none string").repartition(5)


@pytest.mark.parametrize("counters", [1, 4, 12, 60, 10_000])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_values_equal_the_whole_count(spark, counters, k):
    rows, df = table(spark)
    got = {}
    for x in profile.top_values(df, df.columns, k, counters).collect():
        got.setdefault(x.name, []).append((x.value, x.n, x.place))
    for at, c in enumerate(df.columns):
        assert sorted(got[c], key=lambda x: x[2]) == whole(rows, at, k), c


def test_what_is_shuffled_is_bounded(spark):
    rows, df = table(spark)
    held = profile._candidates(df.selectExpr("CAST(zipf AS STRING) AS zipf", "CAST(key AS STRING) AS key"), ["zipf", "key"], 20).groupBy("name").count().collect()
    assert all(x["count"] <= 5 * 20 + 1 for x in held)
    by = {x.value: (x.least, x.missed) for x in profile._candidates(df.select("zipf").selectExpr("CAST(zipf AS STRING) AS zipf"), ["zipf"], 20).collect()}
    missed = sum(m for _, m in by.values())
    for v, n in Counter(str(r[1]) for r in rows).items():
        least = by.get(v, (0, 0))[0]
        assert least <= n <= least + missed


def test_empty_tables(spark):
    _, df = table(spark)
    assert profile.top_values(df.limit(0), ["key", "few"], 3).count() == 0


def test_too_many_combinations_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(i, i, 1) for i in range(20)] + [(None, 1, 2)], "a int, b int, n int")
    assert scenario.completed(df, ["a", "b"], {"n": 0}).count() == 21 * 20
    monkeypatch.setattr(scenario, "MAX_COMBINATIONS", 100)
    with pytest.raises(ValueError, match="combinations"):
        scenario.completed(df, ["a", "b"], {"n": 0})
