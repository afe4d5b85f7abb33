"""Every registered query equals its SQL on the smallest data."""

import duckdb
import pytest

from termindex.plans.oracle import SQL
from termindex.plans.registered import QUERIES
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for table in TABLES:
        found.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return found


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    _, same_columns, ours, theirs, _ = compare(spark, connection, SF, name)
    assert same_columns
    assert ours == theirs
    assert ours
