"""Upkeep of item definitions: catalogs, documents and job runs as DataFrame jobs."""

from lakemart.operators.catalog import (
    NOT_EXISTS,
    change_set,
    exclude,
    in_scope,
    lookup,
    orphans,
    publish,
    rebind,
    rebind_map,
    report_model,
    report_without_model,
    resolve_ref,
    resolve_rules,
    resolve_tokens,
    with_model,
)
from lakemart.operators.documents import (
    find_key,
    find_replace,
    malformed,
    package,
    repair_notebooks,
    resolve_pairs,
    rewrite_array,
    rewrite_pipelines,
    swap,
)
from lakemart.operators.runs import final_status

__all__ = [
    "NOT_EXISTS",
    "change_set",
    "exclude",
    "final_status",
    "find_key",
    "find_replace",
    "in_scope",
    "lookup",
    "malformed",
    "orphans",
    "package",
    "publish",
    "rebind",
    "rebind_map",
    "repair_notebooks",
    "report_model",
    "report_without_model",
    "resolve_pairs",
    "resolve_ref",
    "resolve_rules",
    "resolve_tokens",
    "rewrite_array",
    "rewrite_pipelines",
    "swap",
    "with_model",
]
