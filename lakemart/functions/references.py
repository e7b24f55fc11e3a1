"""Recognising references: UUIDs in their accepted spellings, and placeholder tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text dropped from a reference before the test for 32 hex digits.
UUID_PREFIXES = ("urn:", "uuid:")
UUID_BRACES = "{}"

# The two placeholder formats, and how the first begins.
ITEM_PREFIX = "$items."
ITEM_TOKEN = r"(?s)^\$items\.([^.]+)\.(.+)\.id\z"
WORKSPACE_TOKEN = "$workspace.id"


def is_uuid(ref: Column) -> Column:
    """True for 32 hex digits, bare, hyphenated, braced or with a urn prefix.

    The version digit is not checked. Null is not a UUID. Most names are shorter
    than 32 characters and are told apart by that alone.
    """
    text = ref.cast("string")
    bare = text
    for prefix in UUID_PREFIXES:
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    bare = F.replace(F.btrim(bare, F.lit(UUID_BRACES)), F.lit("-"), F.lit(""))
    long_enough = F.length(text) >= 32
    return F.coalesce(long_enough & bare.rlike(r"^[0-9a-fA-F]{32}\z"), F.lit(False))


def token_parts(token: Column) -> tuple[Column, Column, Column]:
    """Split an item placeholder: (is it one, item type, item name)."""
    return (
        F.coalesce(token.startswith(ITEM_PREFIX) & token.rlike(ITEM_TOKEN), F.lit(False)),
        F.regexp_extract(token, ITEM_TOKEN, 1),
        F.regexp_extract(token, ITEM_TOKEN, 2),
    )
