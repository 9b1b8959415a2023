"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_by_name

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows_by_name(df.columns, df.collect())
    if name in SQL:
        result = con.execute(SQL[name])
        assert got == rows_by_name([d[0] for d in result.description], result.fetchall())
    else:
        assert got[1]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert all(r["id"] != 1 and r["name"] for r in rows)
