"""Searching, rewriting and packaging tables of JSON definitions.

A definition table has one row per document: a unique key column (``doc_id``) and
the JSON text (``body``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemart.functions.arrays import any_differs, set_ids
from lakemart.functions.definitions import computed, find_nodes, has_keys, may_contain, refusal
from lakemart.functions.rewriting import (
    ARTIFACT_ID,
    CONNECTION_KEYS,
    ITEM_KEYS,
    NOTEBOOK_ID,
    Edited,
    Edits,
    edit_text,
    edited_array,
    rewrite_notebook,
    rewrite_pipeline,
)
from lakemart.functions.shapes import PipelineEdit, as_shape, shape_pattern, spaced
from lakemart.functions.text import (
    Rule,
    base64_payload,
    close_pairs,
    replace_by_environment,
)
from lakemart.operators.catalog import lookup, rebind_map, resolve_ref
from lakemart.operators.joins import first_match, helpers

# Levels of a document searched by exploding; what lies deeper is searched within the row.
EXPLODED_LEVELS = 12

# Item types whose references in pipelines are rewritten.
PIPELINE_TYPES = ("Warehouse", "Lakehouse", "Notebook")

# Names in an update request.
PIPELINE_PART = "pipeline-content.json"
PAYLOAD_TYPE = "InlineBase64"

# What holds an item's id; within the id escapes may occur, in the names they don't.
ITEM_IDS = rf'"(?:{ARTIFACT_ID}|{NOTEBOOK_ID})"\s*:\s*"((?:[^"\\]++|\\.)*+)"'

EDITED = "struct<body:string,unresolved:array<string>,error:string>"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def find_replace(
    docs: DataFrame,
    rules: Sequence[Rule],
    environment: str | Column,
    body: str = "body",
    alias: str | None = None,
) -> DataFrame:
    """Apply replacement rules of each row's environment (a column name or expression)."""
    env = environment if isinstance(environment, Column) else _col(environment)
    return docs.withColumn(alias or body, replace_by_environment(_col(body), env, rules))


def find_key(
    docs: DataFrame,
    key: str | Sequence[str],
    body: str = "body",
    alias: str = "value",
    levels: int = EXPLODED_LEVELS,
    key_alias: str | None = None,
    error_alias: str | None = None,
) -> DataFrame:
    """One row per value stored under ``key`` at any depth, matches inside matches too.

    Several keys are searched in one pass; ``key_alias`` names a column that tells which
    key a value was found under. Every document is parsed once and taken apart level by
    level with a generator, in one stage without a shuffle. Matches found on the way
    ride along in an array, on the first child of the node. Nodes left after ``levels``
    levels are searched to their end within the row, so no depth is cut off. The other
    columns of ``docs`` travel along (select those needed first), the body is dropped.

    Text that Spark's parser refuses has no values. With ``error_alias`` the same parse
    gives one row for each such document, with a null value and the reason
    (:func:`refusal`) in that column, which is null for values found: together the rows
    account for every document that has one of the keys in its text, whatever the
    session's settings. An object with a key twice keeps the last value where
    ``spark.sql.variant.allowDuplicateKeys`` is set, and is refused otherwise.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in docs.columns if c != body]
    kept = [_col(c) for c in others]
    node, hits, pos, name, child, why = helpers(["node", "hits", "pos", "name", "child", "why"], docs)
    nothing = F.array().cast("array<struct<key:string,node:variant>>")
    found = docs.where(may_contain(_col(body), *[[k] for k in keys])).select(
        *kept, _col(body), F.try_parse_json(_col(body)).alias(node), nothing.alias(hits)
    )
    refused = [] if error_alias is None else [F.col(why)]
    reason = F.when(F.col(node).isNull(), refusal(_col(body))).alias(why)
    found = found.select(*kept, node, hits, *([reason] if refused else []))
    for _ in range(levels):
        children = docs.sparkSession.tvf.variant_explode_outer(F.col(node).outer())
        first = F.coalesce(F.col(pos), F.lit(0)) == 0
        inherited = F.when(first, F.col(hits)).otherwise(nothing)
        hit = F.array(F.struct(F.col(name).alias("key"), F.col(child).alias("node")))
        going = F.col(node).isNotNull() | (F.size(hits) > 0)
        for c in refused:
            going = going | c.isNotNull()
        found = (
            found.lateralJoin(children.toDF(pos, name, child))
            .select(
                *kept,
                F.col(child).alias(node),
                F.when(F.col(name).isin(keys), F.concat(inherited, hit))
                .otherwise(inherited)
                .alias(hits),
                *refused,
            )
            .where(going)
        )
    rest = F.when(F.col(node).isNull(), F.col(hits)).otherwise(
        F.concat(F.col(hits), find_nodes(F.col(node), keys))
    )
    for c in refused:
        no_value = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("node"))
        rest = F.when(c.isNotNull(), F.array(no_value)).otherwise(rest)
    (hit_,) = helpers(["hit"], docs)
    exploded = found.select(*kept, F.explode(rest).alias(hit_), *refused)
    named = [] if key_alias is None else [F.col(f"{hit_}.key").alias(key_alias)]
    errors = [c.alias(error_alias) for c in refused]
    return exploded.select(
        *[_col(c) for c in others if c not in (alias, key_alias, error_alias)],
        *named,
        F.col(f"{hit_}.node").alias(alias),
        *errors,
    )


def malformed(docs: DataFrame, body: str = "body", reason: str | None = None) -> DataFrame:
    """Documents that Spark's JSON parser refuses; ``reason`` names a column that tells why."""
    refused = docs.where(_col(body).isNotNull() & F.try_parse_json(_col(body)).isNull())
    return refused if reason is None else refused.withColumn(reason, refusal(_col(body)))


def rewrite_array(
    df: DataFrame,
    entries: str,
    target: Column,
    field: str = "id",
    alias: str | None = None,
    updated: str = "updated",
) -> DataFrame:
    """Set ``field`` of every array entry to ``target`` and flag rows where one differed."""
    return df.withColumns(
        {
            alias or entries: set_ids(_col(entries), target, field),
            updated: any_differs(_col(entries), target, field),
        }
    )


def swap(
    df: DataFrame, column: str, pairs: Iterable[tuple[str, str]], alias: str | None = None
) -> DataFrame:
    """Replace values by an ordered list of (from, to) pairs; later pairs see earlier results.

    The list is closed to a one-step map first and looked up as a literal map, so a
    row costs one lookup however many pairs there are. No job, no join.
    """
    closed = {old: new for old, new in close_pairs(pairs).items() if old != new}
    if not closed:
        return df.withColumn(alias or column, _col(column))
    # two array literals: an expression of one size for any number of pairs
    mapping = F.map_from_arrays(F.lit(list(closed)), F.lit(list(closed.values())))
    return df.withColumn(alias or column, F.coalesce(mapping[_col(column)], _col(column)))


def resolve_pairs(
    pairs: Sequence[tuple[str, str]], connections: DataFrame
) -> list[tuple[str, str]]:
    """Resolve names among (from, to) pairs to connection ids; an unknown name is an error.

    ``connections`` has ``connection_id`` and ``connection_name``. At most one row
    per name in the list is read back.
    """
    pairs = [(old, new) for old, new in pairs if old]
    names = sorted({text for pair in pairs for text in pair})
    if not names:
        return []
    refs = connections.sparkSession.createDataFrame([(n,) for n in names], "ref string")
    named = connections.where(F.col("connection_name").isin(names))
    rows = resolve_ref(
        refs, "ref", named, name="connection_name", value="connection_id"
    ).collect()
    ids = {row["ref"]: row["resolved"] for row in rows}
    unknown = [name for name in names if ids[name] is None]
    if unknown:
        raise ValueError(f"no such connection: {unknown}")
    return [(ids[old], ids[new]) for old, new in pairs]


def _item_edits(
    source_items: DataFrame, target_items: DataFrame, types: Sequence[str]
) -> DataFrame:
    """(type, old_id, new_id, endpoint): per wanted type and old id, the target item of that name.

    One row per type and old id, also where a source id has several names: the smallest
    new id wins, as everywhere.
    """
    endpoint = _col("endpoint") if "endpoint" in target_items.columns else F.lit(None)
    target = first_match(
        target_items.where(_col("type").isin(list(types))),
        keys={"type": _col("type"), "name": _col("display_name")},
        values={"new_id": _col("id"), "endpoint": endpoint.cast("string")},
        order=[_col("id")],
    )
    source = source_items.select(_col("id").alias("old_id"), _col("display_name").alias("old_name"))
    paired = source.join(target, F.col("old_name") == F.col("name"))
    return first_match(
        paired,
        keys={"type": F.col("type"), "old_id": F.col("old_id")},
        values={"new_id": F.col("new_id"), "endpoint": F.col("endpoint")},
        order=[F.col("new_id")],
    )


def item_ids(body: Column) -> Column:
    """The ids a pipeline definition may refer to, some too many but none too few.

    Found by a pattern. A text with escapes is copied by the JSON parser first, which
    spells every name without them; what is no JSON is searched as it is.
    """
    escaped = body.contains("\\")
    plain = F.when(escaped, F.coalesce(F.get_json_object(body, "$"), body)).otherwise(body)
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(ITEM_IDS), F.lit(1)))
    read = F.transform(found, lambda i: F.get_json_object(F.concat(F.lit('["'), i, F.lit('"]')), "$[0]"))
    return F.when(escaped, read).otherwise(found)


def rewrite_pipelines(
    docs: DataFrame,
    source_items: DataFrame,
    target_items: DataFrame,
    workspace_id: str,
    pairs: Sequence[tuple[str, str]] = (),
    types: Sequence[str] = PIPELINE_TYPES,
    body: str = "body",
    shape: str | T.StructType | None = None,
) -> DataFrame:
    """Point the references inside pipeline definitions to the target workspace.

    At any depth: linked services and notebook activities outside the workspace get
    the id of the target item of the same name (warehouses their endpoint too), and
    external connections are swapped by the ordered ``pairs``. Adds ``new_body`` (the
    old text where nothing changed), ``changed``, ``unresolved`` (type:id of items
    without a counterpart, left alone) and ``error`` (of a document that names
    something to rewrite, but cannot be read). Columns of these names are replaced.

    The ids found in the documents are joined to the catalogs, and the edits go back to
    the documents by a digest of their text: they depend on nothing else, so no key
    column is needed and equal texts share them. A text that a large part of the
    documents have is no bottleneck: its ids are made distinct before they are shuffled,
    and the join that brings the edits back can be split. Documents that name nothing
    to rewrite take no part in that; their texts are not shuffled.

    With a ``shape`` (a struct type or its DDL, see :mod:`lakemart.functions.shapes`)
    documents that fit it are read, edited and written as typed columns in the JVM; only
    the others are walked as trees in Python. Both give the same JSON; a field that
    a document did not have stands last after one, and where the shape has it after the other.
    """
    wanted = frozenset(types)
    swaps = close_pairs(pairs)
    edits = _item_edits(source_items, target_items, types)
    groups = (*ITEM_KEYS, *CONNECTION_KEYS) if swaps else ITEM_KEYS
    docs = computed(docs, body)
    may_change = F.coalesce(has_keys(_col(body), *groups), F.lit(False))
    one, two, own, tree, new, text, edited = helpers(
        ["digest", "digest_too", "own", "tree", "new", "text", "edited"], docs
    )

    @F.arrow_udf(EDITED)
    def rewrite(bodies: pa.Array, known: pa.Array) -> pa.Array:
        rows = []
        for document, entries in zip(bodies.to_pylist(), known.to_pylist(), strict=True):
            mine: Edits = {
                (kind, e["old_id"]): (new["new_id"], new["endpoint"])
                for e in entries or []
                for kind, new in e["found"].items()
                if new is not None
            }
            edit = lambda tree: rewrite_pipeline(tree, workspace_id, wanted, mine, swaps)
            rows.append(edit_text(document, edit))
        return edited_array(rows)

    def digested(test: Column) -> DataFrame:
        digests = {one: F.xxhash64(_col(body)), two: F.xxhash64(F.lit(1), _col(body))}
        return docs.where(test).withColumns(digests)

    readable = digested(may_change)
    uses = readable.select(
        F.col(one).alias("one"), F.col(two).alias("two"), F.explode(item_ids(_col(body))).alias("id")
    )
    # one row per id for all its types; grouped by a hash beside the key here and below, so
    # that both joins have an exchange on both sides
    by_type = [F.max(F.when(F.col("type") == t, F.struct("new_id", "endpoint"))).alias(t) for t in PIPELINE_TYPES]
    by_id = edits.groupBy(F.xxhash64("old_id", F.lit(1)).alias("spread"), "old_id").agg(*by_type)
    by_id = by_id.select("old_id", F.struct(*PIPELINE_TYPES).alias("found"))
    known = (
        uses.distinct()
        .join(by_id, F.col("id") == F.col("old_id"))
        .groupBy(F.xxhash64("one", "two", F.lit(2)).alias("spread"), "one", "two")
        .agg(F.collect_list(F.struct("old_id", "found")).alias("own"))
        .select(F.col("one").alias(one), F.col("two").alias(two), F.col("own").alias(own))
    )

    def in_python(df: DataFrame) -> DataFrame:
        joined = df.join(known, [one, two], "left")
        return _finished(joined.withColumn(edited, rewrite(_col(body), F.col(own))), docs.columns, body, edited)

    unchanged = _finished(docs.where(~may_change).withColumn(edited, _nothing()), docs.columns, body, edited)
    if shape is None:
        return unchanged.unionByName(in_python(readable))

    kind = as_shape(shape)
    pattern = shape_pattern(kind)
    joined = digested(may_change & _col(body).rlike(pattern)).join(known, [one, two], "left")
    nothing = F.array().cast(known.schema[own].dataType)
    typed = joined.select(
        *[_col(c) for c in docs.columns],
        F.map_from_entries(F.coalesce(F.col(own), nothing)).alias(own),
        F.from_json(_col(body), kind).alias(tree),
    )
    edit = PipelineEdit(kind, workspace_id, types, F.col(own), swaps)
    typed = typed.withColumn(new, edit.apply(F.col(tree)))
    typed = typed.withColumn(text, F.when(~F.col(new).eqNullSafe(F.col(tree)), F.to_json(new)))
    result = F.struct(
        spaced(F.col(text), kind).alias("body"),
        F.sort_array(F.array_distinct(edit.missing(F.col(tree)))).alias("unresolved"),
        F.lit(None).cast("string").alias("error"),
    )
    in_jvm = _finished(typed.withColumn(edited, result), docs.columns, body, edited)
    rest = digested(may_change & ~_col(body).rlike(pattern))
    return unchanged.unionByName(in_jvm).unionByName(in_python(rest))


def _nothing() -> Column:
    return F.lit(None).cast(EDITED)


def _finished(df: DataFrame, columns: Sequence[str], body: str, edited: str) -> DataFrame:
    """The columns of the documents and what the struct ``edited`` says of them."""
    added = {
        "new_body": F.coalesce(F.col(f"{edited}.body"), _col(body)),
        "changed": F.col(f"{edited}.body").isNotNull(),
        "unresolved": F.coalesce(F.col(f"{edited}.unresolved"), F.array().cast("array<string>")),
        "error": F.col(f"{edited}.error"),
    }
    return df.select(
        *[_col(c) for c in columns if c not in added], *[c.alias(name) for name, c in added.items()]
    )


NOTEBOOK = """struct<metadata:struct<dependencies:struct<
    lakehouse:struct<default_lakehouse_name:string,default_lakehouse_workspace_id:string,
        known_lakehouses:string>,
    warehouse:struct<default_warehouse:string>>>,_unread:string>"""

# What a notebook must contain for something to be repaired.
NOTEBOOK_KEYS = (("lakehouse", "default_lakehouse_name"), ("warehouse", "default_warehouse"))


def repair_notebooks(
    docs: DataFrame,
    source_items: DataFrame,
    target_items: DataFrame,
    workspace_id: str,
    body: str = "body",
) -> DataFrame:
    """Point notebooks to the lakehouses and warehouses of the target workspace.

    The default lakehouse is found by its name, the default warehouse by the name
    its id has in the source. Attached lakehouses all become the default one,
    attached warehouses only where they were the old default. Items that are not
    found leave their part as it is. Adds ``new_body``, ``changed``, ``unresolved``
    (type:name of lakehouses and type:id of warehouses without a counterpart) and
    ``error`` (of a notebook that cannot be read); columns of these names are replaced.

    What is looked up are narrow rows, one per different text: a digest, the names and
    the ids attached, read from the notebook in the JVM. One join against both kinds of
    items answers them, and the answers return to the bodies, which are shuffled once, by
    the digest. A text that many notebooks share is no bottleneck (see
    :func:`rewrite_pipelines`). Only notebooks that will change, or that the JVM cannot
    read, reach Python.
    """
    may_change = F.coalesce(may_contain(_col(body), *NOTEBOOK_KEYS), F.lit(False))
    one, two, lakehouse, warehouse, needed, missing, edited = helpers(
        ["digest", "digest_too", "lakehouse", "warehouse", "needed", "missing", "edited"], docs
    )
    candidates = docs.where(may_change).withColumns(
        {one: F.xxhash64(_col(body)), two: F.xxhash64(F.lit(1), _col(body))}
    )
    read = F.from_json(_col(body), NOTEBOOK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    home = "fields.metadata.dependencies"
    known = F.from_json(F.col(f"{home}.lakehouse.known_lakehouses"), "array<struct<id:string>>")
    narrow = (
        candidates.select(F.col(one).alias("one"), F.col(two).alias("two"), read.alias("fields"))
        .select(
            "one",
            "two",
            F.col(f"{home}.lakehouse.default_lakehouse_name").alias("name"),
            F.col(f"{home}.warehouse.default_warehouse").alias("old"),
            F.col(f"{home}.lakehouse.default_lakehouse_workspace_id").eqNullSafe(F.lit(workspace_id)).alias("home"),
            F.array_distinct(F.transform(known, lambda e: e["id"])).alias("attached"),
            (F.col("fields._unread").isNotNull() | F.col("fields.metadata").isNull()).alias("unread"),
        )
        .distinct()
    )
    asked = F.array(
        F.struct(F.lit("Lakehouse").alias("kind"), F.col("name").alias("key")),
        F.struct(F.lit("Warehouse").alias("kind"), F.col("old").alias("key")),
    )
    questions = narrow.select(
        "*", F.inline_outer(F.filter(asked, lambda a: a["key"].isNotNull())).alias("kind", "key")
    )
    answered = lookup(
        questions, _notebook_items(source_items, target_items), {"kind": "kind", "key": "key"}, default=None, alias="id"
    )

    def answer(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("id"))).alias(kind.lower())

    fields = ["name", "old", "home", "attached", "unread"]
    # grouped by a hash beside the digest, so that the join below has an exchange on both sides
    found = answered.groupBy(F.xxhash64("one", "two", F.lit(2)).alias("spread"), "one", "two").agg(
        *[F.first(c).alias(c) for c in fields], answer("Lakehouse"), answer("Warehouse")
    )
    moved = ~F.col("home") | F.coalesce(F.exists("attached", lambda i: ~i.eqNullSafe(F.col("lakehouse"))), F.lit(False))
    verdicts = found.select(
        F.col("one").alias(one),
        F.col("two").alias(two),
        F.col("lakehouse").alias(lakehouse),
        F.col("warehouse").alias(warehouse),
        (
            (F.col("lakehouse").isNotNull() & moved)
            | (F.col("warehouse").isNotNull() & (F.col("warehouse") != F.col("old")))
            | F.col("unread")
        ).alias(needed),
        F.array_compact(
            F.array(
                F.when(F.col("lakehouse").isNull(), F.concat(F.lit("Lakehouse:"), F.col("name"))),
                F.when(F.col("warehouse").isNull(), F.concat(F.lit("Warehouse:"), F.col("old"))),
            )
        ).alias(missing),
    ).where(F.col(needed) | (F.size(missing) > 0))

    @F.arrow_udf(EDITED)
    def rewrite(bodies: pa.Array, lakehouses: pa.Array, warehouses: pa.Array) -> pa.Array:
        rows = []
        columns = (bodies.to_pylist(), lakehouses.to_pylist(), warehouses.to_pylist())
        for text, lh, wh in zip(*columns, strict=True):
            edit = lambda tree: (rewrite_notebook(tree, workspace_id, lh, wh), [])  # noqa: E731, B023
            rows.append(edit_text(text, edit))
        return edited_array(rows)

    joined = candidates.join(verdicts, [one, two], "left")
    result = rewrite(F.when(F.col(needed), _col(body)), F.col(lakehouse), F.col(warehouse))
    # what a notebook lacks was found by the lookup, not by the rewriting
    changed = joined.withColumn(edited, result).withColumn(
        edited, F.struct(F.col(f"{edited}.body"), F.col(missing).alias("unresolved"), F.col(f"{edited}.error"))
    )
    unchanged = docs.where(~may_change).withColumn(edited, _nothing())
    return _finished(unchanged, docs.columns, body, edited).unionByName(
        _finished(changed, docs.columns, body, edited)
    )


def _notebook_items(source_items: DataFrame, target_items: DataFrame) -> DataFrame:
    """(kind, key, id): target lakehouses by name, target warehouses by id of the source or their own."""
    lakehouses = target_items.where(_col("type") == "Lakehouse").select(
        F.lit("Lakehouse").alias("kind"), _col("display_name").alias("key"), _col("id")
    )
    warehouses = target_items.where(_col("type") == "Warehouse").select("id", "display_name")
    mapping = rebind_map(source_items.select("id", "display_name"), warehouses, ["display_name"])
    kind = F.lit("Warehouse").alias("kind")
    moved = mapping.select(kind, F.col("old_id").alias("key"), F.col("new_id").alias("id"))
    # an id of the target stays what it is
    stays = warehouses.select(kind, F.col("id").alias("key"), F.col("id"))
    return lakehouses.union(moved).union(stays)


def package(
    docs: DataFrame,
    old: str = "body",
    new: str = "new_body",
    path: str = PIPELINE_PART,
    payload: str = "payload",
    request: str | None = None,
) -> DataFrame:
    """Changed documents with their base64 payload, and the update request if named."""
    changed = docs.where(_col(new) != _col(old)).withColumn(payload, base64_payload(_col(new)))
    if request is None:
        return changed
    part = F.struct(
        F.lit(path).alias("path"),
        _col(payload).alias("payload"),
        F.lit(PAYLOAD_TYPE).alias("payloadType"),
    )
    definition = F.struct(F.struct(F.array(part).alias("parts")).alias("definition"))
    return changed.withColumn(request, F.to_json(definition))
