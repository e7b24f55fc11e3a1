"""Type conversion to a sink schema and batch append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _counts_a_boolean(have: T.DataType, want: T.DataType) -> bool:
    """Whether a cast would turn a boolean into a number, at any depth."""
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return _counts_a_boolean(have.elementType, want.elementType)
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        pairs = ((have.keyType, want.keyType), (have.valueType, want.valueType))
        return any(_counts_a_boolean(a, b) for a, b in pairs)
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return any(_counts_a_boolean(a.dataType, b.dataType) for a, b in zip(have, want))
    return isinstance(have, T.BooleanType) and isinstance(want, T.NumericType)


def convert(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Match ``df`` to ``schema`` by column name and cast each column.

    Lossy casts are allowed (2.9 becomes 2), values that do not fit raise under
    ANSI. A boolean is not a number: such a column is refused while planning, also
    where the boolean lies inside an array, map or struct.
    Columns the sink does not have are left out; a missing one is an error.
    """
    have = {field.name: field.dataType for field in df.schema}
    missing = [field.name for field in schema if field.name not in have]
    if missing:
        raise ValueError(f"columns missing in the source: {missing}")
    for field in schema:
        if _counts_a_boolean(have[field.name], field.dataType):
            raise TypeError(f"column {field.name}: a boolean is not converted to a number")
    return df.select(
        *[F.col(f"`{field.name}`").cast(field.dataType).alias(field.name) for field in schema]
    )


def append(
    df: DataFrame,
    table: str,
    fmt: str = "parquet",
    path: str | None = None,
    compression: str = "snappy",
) -> None:
    """Append ``df`` to ``table``, creating it (unpartitioned) when it is missing.

    An existing table fixes the schema, and ``df`` is converted to it first. Rows
    are added as they are: running the same append twice doubles them.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df = convert(df, spark.table(table).schema)
    writer = df.write.mode("append").format(fmt).option("compression", compression)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
