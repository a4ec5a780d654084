"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from catalogue.adapters import TABLES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_of_the_catalogue_has_sql():
    for part in entry._PARTS:
        if part.__name__.startswith("catalogue."):
            assert set(part.QUERIES) == set(part.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    table = entry.queries()[name](spark, SF)
    got = rows_of(table.columns, [tuple(r) for r in table.collect()])
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(table.columns) == sorted(columns)
    assert got == rows_of(columns, result.fetchall())
