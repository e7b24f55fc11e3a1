"""Lakehouse data marts and definition upkeep as plain PySpark DataFrame code."""
