"""Every query with a SQL counterpart gives the same rows in Spark and DuckDB."""

import pytest
from differential import compare, oracle_connection

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    n, problem = compare(spark, con, SF_DIR, QUERIES[name], SQL[name])
    assert not problem
    assert n > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["facet"] for r in rows} == {"content", "genre", "director", "actor"}
    assert all(r["rank"] <= 5 and r["title"] != r["seed_title"] for r in rows if r["facet"] in ("director", "actor"))
