"""Tree inventories and species lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_risk(species: DataFrame, above: list[str], below: list[str], keys: list[str], year: int) -> DataFrame:
    """Species with any of the risks over 0 (above) or under 0 (below): long by risk, of those whose name has the year."""
    any_ = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in above] + [F.col(c) < 0 for c in below])
    out = species.where(any_).unpivot(keys, [*above, *below], "var", "value")
    return out.withColumn("year", F.regexp_extract("var", "(20(?:50|70))", 1).cast("int")).where(F.col("year") == year)


def taxon(name: str = "TaxonName"):
    """The part before ` = `, trimmed."""
    return F.trim(F.split_part(F.col(name), F.lit("="), F.lit(1)))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def match_names(trees: DataFrame, species: DataFrame, resolved: DataFrame, name: str, target: str, key: str) -> DataFrame:
    """Match names to species in two passes: as they are, then what is left by a table of resolved names (name, target).

    All trees stay; `method` is exact, resolved or null.
    """
    known = species.select(F.col(target).alias("matched")).distinct()
    exact = trees.join(known, F.col(name) == F.col("matched"), "left_semi").withColumns({"matched": F.col(name), "method": F.lit("exact")})
    rest = trees.join(known, F.col(name) == F.col("matched"), "left_anti")
    table = first_rows(resolved.select(F.col(name).alias("__name"), F.col(target).alias("matched")), ["__name"], ["matched"]).join(known, "matched", "left_semi")
    second = rest.join(table, F.col(name) == F.col("__name"), "left").drop("__name").withColumn("method", F.when(F.col("matched").isNotNull(), "resolved"))
    return exact.unionByName(second)


def union_distinct(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both tables, missing columns null, one for each key: the first in the order."""
    return first_rows(a.unionByName(b, allowMissingColumns=True), keys, order)


def with_risk(records: DataFrame, risks: DataFrame, taxon: str) -> DataFrame:
    """All tree records with the columns of the risk list of their taxon; each taxon stands once in the list."""
    return records.join(first_rows(risks, [taxon], [c for c in risks.columns if c != taxon]), taxon, "left").select(*records.columns, *[c for c in risks.columns if c != taxon])
