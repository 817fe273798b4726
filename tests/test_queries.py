"""Every registered query against its SQL in DuckDB, value by value; those without SQL must give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from heatgrid.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.9g}"
    return str(value)[:10] if hasattr(value, "year") else str(value)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, D)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    want = oracle.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(got.columns)
    mine = sorted([plain(r[c]) for c in order] for r in rows)
    theirs = sorted([plain(r[names.index(c)]) for c in order] for r in want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b or all(x == y or math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
