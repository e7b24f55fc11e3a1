"""How catalogs are made unique and joined to big tables, and names for helper columns.

No join here is told to broadcast: adaptive execution does so when a side turns out to
be small, and otherwise sorts, merges and splits hot keys. It can only split when both
inputs of the join come straight from a shuffle, which is why :func:`first_match` groups
by a hash next to the key: the result is not already partitioned by the key, so the
(small) catalog side is shuffled once more instead of blocking the split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def helpers(names: Sequence[str], *frames: DataFrame) -> list[str]:
    """Names for helper columns that none of the frames has, whatever their case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    found = []
    for name in names:
        new, n = f"_{name}", 0
        while new.lower() in taken:
            n += 1
            new = f"_{name}_{n}"
        taken.add(new.lower())
        found.append(new)
    return found


def first_match(
    catalog: DataFrame, keys: dict[str, Column], values: dict[str, Column], order: Sequence[Column]
) -> DataFrame:
    """One row per key: the values of the row that comes first by ``order``.

    Rows without an order or with a null key are no candidates; equal ones are told
    apart by their values.
    """
    ranks = [f"rank{i}" for i in range(len(order))]
    key = F.struct(*[c.alias(f"key{i}") for i, c in enumerate(keys.values())])
    value = F.struct(
        *[c.alias(name) for name, c in zip(ranks, order, strict=True)],
        *[c.alias(f"value{i}") for i, c in enumerate(values.values())],
    )
    rows = catalog.select(key.alias("key"), value.alias("value"))
    for i in range(len(keys)):
        rows = rows.where(F.col(f"key.key{i}").isNotNull())
    for rank in ranks:
        rows = rows.where(F.col(f"value.{rank}").isNotNull())
    rows = rows.select(
        *[F.col(f"key.key{i}").alias(f"key{i}") for i in range(len(keys))],
        F.xxhash64("key", F.lit(0)).alias("spread"),
        "value",
    )
    found = rows.groupBy("spread", *[f"key{i}" for i in range(len(keys))]).agg(F.min("value").alias("first"))
    return found.select(
        *[F.col(f"key{i}").alias(name) for i, name in enumerate(keys)],
        *[F.col(f"first.value{i}").alias(name) for i, name in enumerate(values)],
    )
