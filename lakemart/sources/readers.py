"""Parquet folder scans, named external locations and in-place table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(
    spark: SparkSession, path: str, pattern: str = "*.parquet", recursive: bool = False
) -> DataFrame:
    """Read the Parquet data in ``path`` whose names match ``pattern``.

    Not recursive: only the direct entries of the folder count, so files in
    subfolders (also ``key=value`` ones) are left alone. An entry that is itself
    a dataset folder written by Spark is read whole. Recursive: files at any
    depth are matched by name. Schema and codec come from the file footers.
    """
    if recursive:
        return (
            spark.read.option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .parquet(path)
        )
    return spark.read.parquet(f"{path.rstrip('/')}/{pattern}")


def _location(location: str, subpath: str) -> str:
    return "/".join(part for part in (location.rstrip("/"), subpath.strip("/")) if part)


def register_source(
    spark: SparkSession, name: str, location: str, subpath: str = "", fmt: str = "parquet"
) -> DataFrame:
    """Make an external location readable under ``name`` for this session."""
    df = spark.read.format(fmt).load(_location(location, subpath))
    df.createOrReplaceTempView(name)
    return spark.table(name)


def create_external_table(
    spark: SparkSession, name: str, location: str, subpath: str = "", fmt: str = "parquet"
) -> DataFrame:
    """Like :func:`register_source`, but kept in the catalog; no data is copied."""
    return spark.catalog.createTable(name, path=_location(location, subpath), source=fmt)


def entity(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """Read a catalog table in place, without importing or caching it."""
    return spark.table(name if schema is None else f"{schema}.{name}")
