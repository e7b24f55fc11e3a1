from __future__ import annotations

from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]


def row_set(df: DataFrame) -> list[tuple]:
    return sorted(rows(df), key=str)


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
