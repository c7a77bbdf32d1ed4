"""Every registered query against its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def database(sf):
    connection = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_of_the_index_has_sql():
    from pageloom.plans.queries import QUERIES as OWN

    assert set(OWN) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf, database, name):
    frame = QUERIES[name](spark, sf)
    result = database.execute(SQL[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(frame.columns)
    places = [columns.index(column) for column in frame.columns]
    expected = [tuple(row[place] for place in places) for row in result.fetchall()]
    got = [tuple(row) for row in frame.collect()]
    assert len(got) > 0
    assert in_order(got) == in_order(expected)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
