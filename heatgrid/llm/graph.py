"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.common import join_dealt, shared_dir


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that stand for the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour; n edges."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    return (
        join_dealt(both.where("v > u"), least, "u", "degree", 2 * n)
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest one; n edges at most."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    moved = join_dealt(down, least, "u", "degree", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (columns u, v; long), component its smallest reachable node.

    Lineage is cut with checkpoint() after each round. Near the end the smallest node of a component has all its edges:
    nodes of many edges are dealt over tasks, by their degree. Self loops, repeated rows and both directions are
    allowed; rows with a null end are ignored; no edges give an empty table.
    """
    shared_dir(edges.sparkSession)
    edges = edges.where("u <> v").select("u", "v").distinct().checkpoint()
    before = _mark(edges)
    for _ in range(max_rounds if before[0] else 0):
        edges = _small_star(_large_star(edges, before[0]), 2 * before[0]).checkpoint()
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component")).distinct()
