"""The queries of this subpackage that have SQL give the same rows as it."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from __spark_entry__ import queries
from lakemart.llm.queries import ORACLES


@pytest.fixture(scope="module")
def duck(oracle_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{oracle_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, oracle_dir, name):
    df = queries()[name](spark, oracle_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    actual = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert actual == sorted(cursor.fetchall(), key=str)
    assert actual
