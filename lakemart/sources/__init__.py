"""Reading Parquet folders and tables, and appending to tables."""

from lakemart.sources.readers import create_external_table, entity, register_source, scan
from lakemart.sources.sinks import append, convert

__all__ = ["append", "convert", "create_external_table", "entity", "register_source", "scan"]
