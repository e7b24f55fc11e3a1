"""Rewriting the ids inside an array of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_ids(entries: Column, target: Column, field: str = "id") -> Column:
    """Every entry with ``field`` set to ``target``; other fields stay."""
    return F.transform(entries, lambda e: e.withField(field, target))


def any_differs(entries: Column, target: Column, field: str = "id") -> Column:
    """Whether some entry's ``field`` is not ``target``; false for a missing array."""
    return F.coalesce(F.exists(entries, lambda e: ~e[field].eqNullSafe(target)), F.lit(False))
