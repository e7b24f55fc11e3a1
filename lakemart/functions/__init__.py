"""Column functions for references, text replacement and JSON definitions."""

from lakemart.functions.arrays import any_differs, set_ids
from lakemart.functions.references import is_uuid, token_parts
from lakemart.functions.text import base64_payload, close_pairs, replace_by_environment

__all__ = [
    "any_differs",
    "base64_payload",
    "close_pairs",
    "is_uuid",
    "replace_by_environment",
    "set_ids",
    "token_parts",
]
