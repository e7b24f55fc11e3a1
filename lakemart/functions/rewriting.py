"""Rewriting parsed JSON definitions in place: the Python run inside Arrow UDF batches.

Spark's Variant can be searched but not updated, and the places to change lie at
any depth, so this one step is Python. Unchanged documents are not serialised
again. The functions travel to the executors by value: this package need not be
installed there.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Collection, Mapping

import pyarrow as pa
from pyspark import cloudpickle

# Document keys and type tags that mark the places to change.
LINKED_SERVICE = "linkedService"
ACTIVITIES = "activities"
EXTERNAL_REFERENCES = "externalReferences"
ARTIFACT_ID = "artifactId"
NOTEBOOK_ID = "notebookId"
WORKSPACE_ID = "workspaceId"
ENDPOINT = "endpoint"
CONNECTION = "connection"
NOTEBOOK_ACTIVITY = "TridentNotebook"
LINKED_TYPES = {"DataWarehouse": "Warehouse", "Lakehouse": "Lakehouse"}

PIPELINE_KEYS = (LINKED_SERVICE, ACTIVITIES, EXTERNAL_REFERENCES)

# What a document must contain for something to be rewritten: items, connections.
ITEM_KEYS = ((LINKED_SERVICE, ARTIFACT_ID), (ACTIVITIES, NOTEBOOK_ID))
CONNECTION_KEYS = ((EXTERNAL_REFERENCES, CONNECTION),)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Edits = Mapping[tuple[str, str], tuple[str, str | None]]
Reference = tuple[str, str, dict, str]


def find_members(tree: object, keys: Collection[str]) -> list[tuple[str, object]]:
    """The (key, value) members of objects at any depth whose key is one of ``keys``."""
    found: list[tuple[str, object]] = []
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            for key, value in node.items():
                if key in keys:
                    found.append((key, value))
                if isinstance(value, (dict, list)):
                    waiting.append(value)
        elif isinstance(node, list):
            waiting.extend(node)
    return found


def _section(node: object, name: str) -> dict:
    value = node.get(name) if isinstance(node, dict) else None
    return value if isinstance(value, dict) else {}


def _entries(value: object) -> list[dict]:
    """The objects of a list; anything else has none."""
    return [e for e in value if isinstance(e, dict)] if isinstance(value, list) else []


def item_references(
    places: list[tuple[str, object]], workspace: str, types: frozenset[str]
) -> list[Reference]:
    """References to items outside ``workspace``: (item type, id, holder, field of the id)."""
    found: list[Reference] = []

    def add(kind: str | None, holder: dict, field: str) -> None:
        if kind in types and holder.get(WORKSPACE_ID) != workspace:
            if isinstance(holder.get(field), str):
                found.append((kind, holder[field], holder, field))

    for key, value in places:
        if key == LINKED_SERVICE:
            properties = _section(value, "properties")
            tag = properties.get("type")
            kind = LINKED_TYPES.get(tag) if isinstance(tag, str) else None
            add(kind, _section(properties, "typeProperties"), ARTIFACT_ID)
        elif key == ACTIVITIES:
            for activity in _entries(value):
                if activity.get("type") == NOTEBOOK_ACTIVITY:
                    add("Notebook", _section(activity, "typeProperties"), NOTEBOOK_ID)
    return found


def rewrite_pipeline(
    tree: object, workspace: str, types: frozenset[str], edits: Edits, swaps: Mapping[str, str]
) -> tuple[bool, list[str]]:
    """Point item references into ``workspace`` and swap connections; (changed, unresolved)."""
    changed = False
    unresolved: set[str] = set()
    places = find_members(tree, PIPELINE_KEYS)
    for kind, old, holder, field in item_references(places, workspace, types):
        if (kind, old) not in edits:
            unresolved.add(f"{kind}:{old}")
            continue
        new, endpoint = edits[kind, old]
        holder[field] = new
        holder[WORKSPACE_ID] = workspace
        if kind == "Warehouse" and endpoint is not None:
            holder[ENDPOINT] = endpoint
        changed = True
    for key, value in places:
        if key == EXTERNAL_REFERENCES and isinstance(value, dict):
            old = value.get(CONNECTION)
            if isinstance(old, str) and swaps.get(old, old) != old:
                value[CONNECTION] = swaps[old]
                changed = True
    return changed, sorted(unresolved)


def rewrite_notebook(
    tree: object, workspace: str, lakehouse: str | None, warehouse: str | None
) -> bool:
    """Set default and attached lakehouses and warehouses to the given ids; changed or not."""
    dependencies = _section(_section(tree, "metadata"), "dependencies")
    changed = False

    def put(holder: dict, field: str, value: str) -> None:
        nonlocal changed
        if holder.get(field) != value:
            holder[field] = value
            changed = True

    attached = _section(dependencies, "lakehouse")
    if lakehouse is not None and "default_lakehouse_name" in attached:
        if attached.get("default_lakehouse_workspace_id") != workspace:
            put(attached, "default_lakehouse", lakehouse)
            put(attached, "default_lakehouse_workspace_id", workspace)
        for entry in _entries(attached.get("known_lakehouses")):
            put(entry, "id", lakehouse)

    attached = _section(dependencies, "warehouse")
    if warehouse is not None and "default_warehouse" in attached:
        old = attached["default_warehouse"]
        put(attached, "default_warehouse", warehouse)
        for entry in _entries(attached.get("known_warehouses")):
            if entry.get("id") == old:
                put(entry, "id", warehouse)
    return changed


Edited = tuple[str | None, list[str], str | None]


def edit_text(body: str | None, edit: Callable[[object], tuple[bool, list[str]]]) -> Edited:
    """Parse, edit and serialise a document: (text or null if unchanged, unresolved, error).

    Whatever goes wrong is an error of this document alone.
    """
    if body is None:
        return None, [], None
    try:
        tree = json.loads(body)
        changed, unresolved = edit(tree)
        return json.dumps(tree) if changed else None, [storable(x) for x in unresolved], None
    except Exception as error:
        return None, [], type(error).__name__


def storable(text: str) -> str:
    """Text that fits a column: half a surrogate pair, legal in JSON, is spelled out."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def edited_array(rows: list[Edited]) -> pa.Array:
    """Results of :func:`edit_text` as an Arrow struct column."""
    bodies, unresolved, errors = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays(
        [
            pa.array(bodies, pa.string()),
            pa.array(unresolved, pa.list_(pa.string())),
            pa.array(errors, pa.string()),
        ],
        ["body", "unresolved", "error"],
    )
