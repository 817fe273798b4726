"""Components by star contraction: against union-find, and where one node has all edges."""

import random

import pytest
from heatgrid.llm import graph
from heatgrid.llm.common import join_dealt
from pyspark.sql import functions as F


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(-5, x) for x in range(2000, 2050)] + [(7, 7), (None, 3), (3, 3)]
    df = spark.createDataFrame(edges + edges[:20], "u long, v long")
    assert {x.node: x.component for x in graph.connected_components(df).collect()} == plain(edges)
    assert graph.connected_components(df.limit(0)).count() == 0


def test_a_node_with_all_edges_is_dealt(spark):
    """A star of 300,000 edges over 4 partitions: no task has more than half of the rows of either step's join."""
    edges = spark.range(1, 300_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        dealt = join_dealt(edges, least, "u", "degree", 300_000)
        rows = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 300_000 and max(rows) < 150_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert graph.connected_components(edges).agg(F.count("*"), F.max("component")).first()[:2] == (300_001, 0)
