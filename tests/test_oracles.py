"""Every query with a SQL twin gives the same rows as DuckDB on the smallest scale."""

import math

import duckdb
import pytest

from cadaspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and not isinstance(v, str) and math.isfinite(v) else v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((repr([cell(v) for v in r]) for r in frame[names].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal_rows(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())
