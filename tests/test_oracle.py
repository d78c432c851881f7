"""Every registered query with a SQL statement gives the same rows as DuckDB on whole tables."""

import duckdb
import pytest
from check import TABLES, compare

from fieldorder.plans import load_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    result, _, _ = compare(spark, con, QUERIES[name], FOLDER)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql and not n.startswith("M")])
def test_runs_without_sql(spark, con, name):
    result, _, _ = compare(spark, con, QUERIES[name], FOLDER)
    assert result.startswith("rows-only") and not result.endswith("n=0"), result
