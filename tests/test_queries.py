"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from gridfolio import queries

from tests import cases

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
queries.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    return "null" if v is None else ("nan" if math.isnan(v) else f"{v:.5f}") if isinstance(v, float) else str(v)


def same(df, duck, sql):
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(shown, r)) for r in cursor.fetchall())
    assert sorted(tuple(shown(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case_gives_the_stated_rows(spark, duck, name):
    same(cases.CASES[name](spark, SF), duck, cases.EXPECTED[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(queries.QUERIES) <= set(e.queries())


def test_grids_of_all_shapes(spark):
    """Each order is a grid: even, ragged, with quoted cells, with blank cells under equal headers, without headers."""
    rows = queries.QUERIES["grid_renderings"](spark, SF).collect()
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert len(rows) == orders + spark.read.parquet(f"{SF}/nation.parquet").select("n_regionkey").distinct().count()
    assert {(r["uniform"], r["formed"]) for r in rows} == {(True, True), (True, False), (False, False)}
    assert any('"""' in r["csv"] for r in rows) and any(r["last"] == "" for r in rows) and any("|   |" in r["markdown"] for r in rows)
