"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftspark.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF_DIR):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_plans(spark):
    def plan(name):
        return entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()

    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan("filter_expr")
    assert "l_tax" not in plan("filter_expr")
    assert plan("rbk_sum").count("Exchange") == 1 and "partial_sum" in plan("rbk_sum")
