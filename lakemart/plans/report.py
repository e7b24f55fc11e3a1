"""Report queries: a sum per category, sorted, and cross-filtering by chosen categories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.plans.model import sum_name, sum_of


def sum_by_category(
    df: DataFrame,
    category: str,
    measure: str,
    category_name: str | None = None,
    measure_name: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Sum of ``measure`` per ``category``, largest sum first, ties by category.

    A null category is a group like any other; a group whose measure is null
    throughout is blank and left out.
    """
    category_name = category if category_name is None else category_name
    measure_name = sum_name(measure) if measure_name is None else measure_name
    sums = (
        df.groupBy(F.col(f"`{category}`").alias(category_name))
        .agg(sum_of(measure).alias(measure_name))
        .where(F.col(f"`{measure_name}`").isNotNull())
    )
    if not ordered:
        return sums
    return sums.orderBy(F.desc(f"`{measure_name}`"), F.asc(f"`{category_name}`"))


def cross_filter(df: DataFrame, key: str, selected: DataFrame | Iterable) -> DataFrame:
    """Keep the rows whose ``key`` is selected; a selected null keeps the null rows.

    A plain list becomes a predicate that reaches the scan. A DataFrame (its
    first column counts) becomes a semi join, however many values it holds.
    """
    column = F.col(f"`{key}`")
    if isinstance(selected, DataFrame):
        chosen = selected.select(F.col(f"`{selected.columns[0]}`").alias("_selected"))
        return df.join(chosen, column.eqNullSafe(F.col("_selected")), "left_semi")
    values = list(selected)
    predicate = column.isin([v for v in values if v is not None])
    return df.where(predicate | column.isNull() if None in values else predicate)
