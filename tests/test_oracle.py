"""Every query with oracle SQL returns the same rows in Spark and in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: str(["" if x is None else x for x in row]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    right = [tuple(row[i] for i in places) for row in expected.fetchall()]
    left = [tuple(row) for row in df.select(*columns).collect()]
    assert ordered(left) == ordered(right)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
