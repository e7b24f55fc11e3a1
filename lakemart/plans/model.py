"""Declared models: which columns are visible, under which name, type and default sum."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The two logical types of a model and their Spark types.
TYPES = {"int64": "bigint", "double": "double"}

# Text that can be an integer at all; the ends are what a cast trims.
INTEGER_TEXT = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*\z"

# The default aggregations a column may declare.
SUMMARIZE_BY = ("none", "sum")


@dataclass(frozen=True)
class Column:
    """A model column read from ``source``; ``summarize_by`` is 'none' or 'sum'."""

    name: str
    source: str
    data_type: str
    summarize_by: str = "none"

    def __post_init__(self) -> None:
        if self.data_type not in TYPES:
            raise ValueError(f"column {self.name}: unknown type {self.data_type}")
        if self.summarize_by not in SUMMARIZE_BY:
            raise ValueError(f"column {self.name}: unknown aggregation {self.summarize_by}")


@dataclass(frozen=True)
class Model:
    """A model over one table; ``errors_as_null`` turns bad cells and overflow into null."""

    name: str
    columns: tuple[Column, ...]
    errors_as_null: bool = True

    def keys(self) -> list[Column]:
        return [c for c in self.columns if c.summarize_by == "none"]

    def measures(self) -> list[Column]:
        return [c for c in self.columns if c.summarize_by == "sum"]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name} has no column {name}")


def view(df: DataFrame, model: Model) -> DataFrame:
    """Project ``df`` to the model's columns; anything not listed stays invisible.

    A failing cast is an exception inside Spark even where it gives null, so text
    that cannot be an integer is sorted out before: dirty columns cost no more
    than clean ones.
    """
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}

    def project(c: Column) -> SparkColumn:
        source = F.col(f"`{c.source}`")
        if not model.errors_as_null:
            return source.cast(TYPES[c.data_type]).alias(c.name)
        value = source.try_cast(TYPES[c.data_type])
        if c.source in texts and c.data_type == "int64":
            value = F.when(source.rlike(INTEGER_TEXT), value)
        return value.alias(c.name)

    return df.select(*[project(c) for c in model.columns])


def sum_name(name: str) -> str:
    """Display name of a default sum."""
    return f"Sum of {name}"


def sum_of(name: str, errors_as_null: bool = True) -> SparkColumn:
    """The sum of a column; with ``errors_as_null`` an overflow gives null."""
    return (F.try_sum if errors_as_null else F.sum)(F.col(f"`{name}`"))


def summarize(
    df: DataFrame,
    model: Model,
    by: Sequence[str] | None = None,
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Default summary of a model view: group by key columns, sum the measures.

    ``by`` and ``measures`` pick some of the model's columns; the defaults are all
    that declare 'none' and all that declare 'sum'.
    """
    by = [c.name for c in model.keys()] if by is None else list(by)
    measures = [c.name for c in model.measures()] if measures is None else list(measures)
    for name in measures:
        if model.column(name).summarize_by != "sum":
            raise ValueError(f"column {name} has no default sum")
    sums = [sum_of(name, model.errors_as_null).alias(sum_name(name)) for name in measures]
    return df.groupBy(*[F.col(f"`{model.column(name).name}`") for name in by]).agg(*sums)
