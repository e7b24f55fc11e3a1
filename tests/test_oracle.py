"""Every registered query gives the same rows as its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from lakemart.queries import ORACLES, QUERIES
from lakemart.session import SETTINGS

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck(oracle_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{oracle_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(row[i] for i in order) for row in rows]
    return sorted(shaped, key=lambda row: tuple((v is not None, str(v)) for v in row))


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def bare(spark):
    """A session that knows none of the package's settings."""
    session = spark.newSession()
    for name in SETTINGS:
        session.conf.unset(name)
    return session


def compare(session, duck, oracle_dir, name):
    df = queries()[name](session, oracle_dir)
    cursor = duck.execute(oracle_sql()[name])
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(expected_columns)
    actual = [tuple(row) for row in df.collect()]
    assert len(actual) > 0
    assert sorted_rows(df.columns, actual) == sorted_rows(expected_columns, expected)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, oracle_dir, name):
    compare(spark, duck, oracle_dir, name)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_without_settings(bare, duck, oracle_dir, name):
    assert bare.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    compare(bare, duck, oracle_dir, name)


def test_entry(spark):
    assert entry(spark).columns == ["category", "sum_measure"]
    assert entry(spark).count() == 50
