"""Consecutive numbers for the rows of a large table, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.common import col, fresh, shuffle_partitions, written

# What the number of a row within its partition takes of a monotonically increasing id.
PLACE_BITS = 33


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """A null-safe condition that two frames agree in some columns."""
    return reduce(and_, [left[f"`{c}`"].eqNullSafe(right[f"`{c}`"]) for c in names], F.lit(True))


def joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that takes nulls in its keys for equal; the keys are there once."""
    theirs = right.withColumnsRenamed({c: fresh(left, f"their_{c}", right) for c in names})
    renamed = dict(zip(names, [c for c in theirs.columns if c not in right.columns], strict=True))
    condition = reduce(and_, [col(c).eqNullSafe(col(n)) for c, n in renamed.items()])
    return left.join(theirs, condition, how).drop(*renamed.values())


def in_order(rows: DataFrame, group: Sequence[str], order: Sequence[str], place: str) -> DataFrame:
    """Rows dealt to partitions by their order and sorted there, with their place as a number.

    Places ascend with the order, nulls first, within a partition and from one to the
    next, but have gaps. Rows that are equal in all these columns may change places; they
    are told apart by where they stand, so that many of them spread over partitions.
    """
    tie = fresh(rows, "tie")
    keys = [col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(
        shuffle_partitions(rows.sparkSession), *keys, F.col(tie).asc()
    )
    sorted_ = dealt.sortWithinPartitions(*keys, F.col(tie).asc()).drop(tie)
    return sorted_.withColumn(place, F.monotonically_increasing_id())


def numbered(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], label: str, alias: str = "number"
) -> DataFrame:
    """Number the rows of each group from 0 in an order, nulls first.

    One range shuffle; the numbers are places in their partition, after the group's rows
    in partitions before it. That table has a row per group and partition it occurs in.
    """
    place, part, first, before = (fresh(rows, c) for c in ("place", "part", "first", "before"))
    # places stay as they are, since they are written
    placed = written(in_order(rows, group, order, place), label).withColumn(
        part, F.shiftright(place, PLACE_BITS)
    )
    counts = placed.groupBy(*[col(c) for c in group], part).agg(F.min(place).alias(first), F.count("*").alias(before))
    window = Window.partitionBy(*[col(c) for c in group]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(before).over(window), F.lit(0)))
    found = joined(placed, starts, [*group, part])
    return found.withColumn(alias, F.col(place) - F.col(first) + F.col(before)).drop(place, part, first, before)
