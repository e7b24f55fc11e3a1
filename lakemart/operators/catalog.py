"""Looking up, rebinding, publishing and clearing items of a catalog.

Catalogs hold ``id``, ``display_name``, ``type`` (and ``workspace_id``) per item;
column names can be given where a table has others. Duplicate names are allowed:
the smallest id wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions.references import WORKSPACE_TOKEN, is_uuid, token_parts
from lakemart.functions.text import Rule
from lakemart.operators.joins import first_match, helpers

# Fixed value: what a lookup gives for a name nobody has.
NOT_EXISTS = "NotExists"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def in_scope(items: DataFrame, types: Iterable[str], type_column: str = "type") -> DataFrame:
    """Items whose type is listed, compared exactly."""
    return items.where(_col(type_column).isin(list(types)))


def lookup(
    df: DataFrame,
    catalog: DataFrame,
    on: Mapping[str, str],
    value: str = "id",
    default: str | None = NOT_EXISTS,
    alias: str | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add the first matching ``value`` of ``catalog`` to each row of ``df``.

    ``on`` maps columns of ``df`` to columns of the catalog: a name, or a name and
    a type. First means smallest by ``order`` (the value itself unless given). A
    row without a match gets ``default``.
    """
    alias = value if alias is None else alias
    *keys, found, salt = helpers([*[f"key{i}" for i in range(len(on))], "value", "salt"], df)
    first = first_match(
        catalog,
        keys={k: _col(theirs) for k, theirs in zip(keys, on.values(), strict=True)},
        values={found: _col(value)},
        order=[_col(c) for c in (order or [value])],
    )
    result = _col(found) if default is None else F.coalesce(_col(found), F.lit(default))
    return _matched(df, first, dict(zip(on, keys, strict=True)), salt).select(
        *[_col(c) for c in df.columns if c != alias], result.alias(alias)
    )


def _matched(df: DataFrame, unique: DataFrame, on: Mapping[str, str], salt: str) -> DataFrame:
    """``df`` left joined to a table with one row per key; ``salt`` is null where none matches."""
    # always 0, but no constant: the optimizer would move that out of the join's keys
    unique = unique.withColumn(salt, F.pmod(F.xxhash64(*[_col(k) for k in on.values()]), F.lit(1)))
    condition = [_col(ours) == _col(k) for ours, k in on.items()]
    # rows with a null key match nothing: a hash of the row spreads them
    missing = F.lit(False)
    for ours in on:
        missing = missing | _col(ours).isNull()
    spread = F.when(missing, F.xxhash64(*[_col(c) for c in _hashable(df)])).otherwise(F.lit(0))
    condition.append(spread.cast("bigint") == _col(salt))
    return df.join(unique, condition, "left")


def _hashable(df: DataFrame) -> list[str]:
    """Columns a hash can take: no maps and variants."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def rebind_map(
    source_items: DataFrame, target_items: DataFrame, by: Sequence[str] = ("display_name", "type")
) -> DataFrame:
    """(old_id, new_id), one row per id: items of the same ``by`` columns in source and target."""
    names = [f"by{i}" for i in range(len(by))]
    target = first_match(
        target_items,
        keys={n: _col(c) for n, c in zip(names, by, strict=True)},
        values={"new_id": _col("id")},
        order=[_col("id")],
    )
    source = source_items.select(
        _col("id").alias("old_id"), *[_col(c).alias(f"own_{n}") for n, c in zip(names, by, strict=True)]
    )
    paired = source.join(target, [F.col(f"own_{n}") == F.col(n) for n in names], "inner")
    return first_match(
        paired, {"old_id": F.col("old_id")}, {"new_id": F.col("new_id")}, [F.col("new_id")]
    )


def rebind(
    df: DataFrame,
    column: str,
    source_items: DataFrame,
    target_items: DataFrame,
    alias: str = "new_id",
    by: Sequence[str] = ("display_name", "type"),
) -> DataFrame:
    """Translate an id to the id of the item of the same name and type in the target.

    Ids that cannot be translated give null. The two catalogs are joined to each
    other first, so ``df`` takes part in one join only. A column named like ``alias``
    is replaced.
    """
    mapping = rebind_map(source_items.select("id", *by), target_items.select("id", *by), by)
    return lookup(df, mapping, {column: "old_id"}, "new_id", default=None, alias=alias)


def resolve_ref(
    df: DataFrame,
    column: str,
    catalog: DataFrame,
    alias: str = "resolved",
    name: str = "display_name",
    value: str = "id",
) -> DataFrame:
    """A reference that is a UUID stays as it is; any other text is a name to look up.

    Unknown names give null. Rows that are ids, and those without a reference, take no
    part in the join: only names are shuffled.
    """
    named = F.coalesce(~is_uuid(_col(column)), F.lit(False)) & _col(column).isNotNull()
    ready = df.where(~named).withColumn(alias, _col(column).cast(catalog.schema[value].dataType))
    looked = lookup(df.where(named), catalog, {column: name}, value, default=None, alias=alias)
    return ready.select(*[_col(c) for c in looked.columns]).unionByName(looked)


def resolve_tokens(
    df: DataFrame,
    column: str,
    items: DataFrame,
    workspace_id: str | Column,
    alias: str = "resolved",
) -> DataFrame:
    """Replace item and workspace placeholders by ids; other text stays.

    ``items`` belong to the target workspace. A placeholder of an unknown item
    gives null.
    """
    token = _col(column)
    is_item, kind, name = token_parts(token)
    workspace = workspace_id if isinstance(workspace_id, Column) else F.lit(workspace_id)
    type_, name_, found = helpers(["type", "name", "found"], df)
    # Rows without an item placeholder have a null key, which the lookup spreads.
    keyed = df.withColumns({type_: F.when(is_item, kind), name_: F.when(is_item, name)})
    looked = lookup(keyed, items, {type_: "type", name_: "display_name"}, default=None, alias=found)
    resolved = (
        F.when(is_item, _col(found)).when(token == F.lit(WORKSPACE_TOKEN), workspace).otherwise(token)
    )
    return looked.withColumn(alias, resolved).drop(type_, name_, found)


def resolve_rules(rules: Sequence[Rule], items: DataFrame, workspace_id: str) -> list[Rule]:
    """Resolve the placeholders among the values of replacement rules.

    Only the items the rules name are read back, at most one row per placeholder.
    An unknown item, and one without an id, is an error.
    """
    texts = sorted({value for _, values in rules for value in values.values()})
    spark = items.sparkSession
    tokens = spark.createDataFrame([(t,) for t in texts], "token string")
    is_item, kind, name = token_parts(F.col("token"))
    wanted = tokens.where(is_item).select(
        "token", kind.alias("_type"), name.alias("_name")
    )
    named = [(row["_type"], row["_name"]) for row in wanted.collect()]
    resolved = {WORKSPACE_TOKEN: workspace_id}
    if named:
        known = items.where(
            F.col("type").isin([k for k, _ in named])
            & F.col("display_name").isin([n for _, n in named])
            & F.col("id").isNotNull()
        )
        rows = (
            known.groupBy("type", "display_name").agg(F.min("id").alias("id"))
            .join(
                F.broadcast(wanted),
                [F.col("type") == F.col("_type"), F.col("display_name") == F.col("_name")],
            )
            .select("token", "id")
            .collect()
        )
        resolved.update((row["token"], row["id"]) for row in rows)
        missing = [row["token"] for row in wanted.collect() if row["token"] not in resolved]
        if missing:
            raise ValueError(f"no such item: {missing}")
    return [
        (find, {env: resolved.get(value, value) for env, value in values.items()})
        for find, values in rules
    ]


def with_model(
    reports: DataFrame,
    models: DataFrame,
    report_key: str = "dataset_id",
    model_key: str = "dataset_id",
    model_name: str = "dataset_name",
    alias: str | None = None,
    present: str = "has_model",
) -> DataFrame:
    """Every report with the name of its model and whether that model exists, from one join.

    A model without a name exists, so its reports have a null name and ``present`` set; of
    several names of one model the smallest wins. Reports that name no model have none.
    """
    alias = model_name if alias is None else alias
    key, name, spread, salt = helpers(["key", "name", "spread", "salt"], reports)
    known = models.select(_col(model_key).alias(key), _col(model_name).alias(name))
    # grouped by a hash beside the key, see the module of the joins
    hashed = F.xxhash64(_col(key), F.lit(0)).alias(spread)
    unique = known.where(_col(key).isNotNull()).groupBy(hashed, _col(key)).agg(F.min(_col(name)).alias(name))
    matched = _matched(reports, unique.drop(spread), {report_key: key}, salt)
    return matched.select(
        *[_col(c) for c in reports.columns if c not in (alias, present)],
        _col(name).alias(alias),
        _col(salt).isNotNull().alias(present),
    )


def report_model(
    reports: DataFrame,
    models: DataFrame,
    report_key: str = "dataset_id",
    model_key: str = "dataset_id",
    model_name: str = "dataset_name",
    alias: str | None = None,
) -> DataFrame:
    """Reports whose model exists, with its name: one half of :func:`with_model`."""
    (present,) = helpers(["present"], reports)
    split = with_model(reports, models, report_key, model_key, model_name, alias, present)
    return split.where(_col(present)).drop(present)


def report_without_model(
    reports: DataFrame,
    models: DataFrame,
    report_key: str = "dataset_id",
    model_key: str = "dataset_id",
) -> DataFrame:
    """Reports whose model does not exist, also those that name none: the other half."""
    name, present = helpers(["name", "present"], reports)
    split = with_model(reports, models, report_key, model_key, model_key, name, present)
    return split.where(~_col(present)).drop(name, present)


def exclude(df: DataFrame, excluded: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner in ``excluded`` (such as default models)."""
    return df.join(excluded.select(*on), list(on), "left_anti")


PUBLISH, REPLACED, KEEP, REMOVE = "publish", "replaced", "keep", "remove"


def change_set(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str] = ("type", "display_name"),
    types: Iterable[str] | None = None,
    type_column: str = "type",
    change: str = "change",
) -> DataFrame:
    """What publishing does to every item, in one pass over both tables.

    In-scope source items are to ``publish``, one row per key: of several with a key the
    smallest, column by column. Target items are ``replaced`` by one of these, to
    ``remove`` if they are in scope and the source has no such key, and to ``keep``
    otherwise. Keys are compared null-safe. The rows have the columns of the target that
    the source has, too, and ``change``.

    A full outer join would tell the same, but adaptive execution cannot split its hot
    keys; the target joined to the keys of the source, with the source's rows beside it,
    can be split.
    """
    listed = None if types is None else list(types)
    columns = [c for c in target.columns if c in source.columns and c != change]
    first = _one_per_key(source if listed is None else in_scope(source, listed, type_column), key)
    *names, salt = helpers([*[f"key{i}" for i in range(len(key))], "salt"], target)
    # the hash beside the key forces an exchange on this side as well
    named = [_col(c).alias(n) for c, n in zip(key, names, strict=True)]
    keys = first.select(*named, F.xxhash64(*[_col(c) for c in key], F.lit(0)).alias(salt)).distinct()
    condition = [_col(c).eqNullSafe(_col(n)) for c, n in zip(key, names, strict=True)]
    inside = F.lit(True) if listed is None else F.coalesce(_col(type_column).isin(listed), F.lit(False))
    label = F.when(_col(salt).isNotNull(), REPLACED).when(inside, REMOVE).otherwise(KEEP)
    old = target.join(keys, condition, "left").select(*[_col(c) for c in columns], label.alias(change))
    new = first.select(*[_col(c) for c in columns], F.lit(PUBLISH).alias(change))
    return new.unionByName(old)


def publish(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str] = ("type", "display_name"),
    types: Iterable[str] | None = None,
    type_column: str = "type",
) -> DataFrame:
    """The target after publishing: in-scope source items overwrite or join its own.

    The :func:`change_set` without what is replaced. The source must have no column that
    the target has not.
    """
    (change,) = helpers(["change"], source, target)
    changes = change_set(source, target.select(*[_col(c) for c in source.columns]), key, types, type_column, change)
    return changes.where(_col(change) != REPLACED).select(*[_col(c) for c in source.columns])


def orphans(
    target: DataFrame,
    source: DataFrame,
    key: Sequence[str] = ("type", "display_name"),
    types: Iterable[str] | None = None,
    type_column: str = "type",
) -> DataFrame:
    """In-scope target items that no item of the source, in scope or not, has the key of.

    What :func:`change_set` removes; the keys of the source are all it needs of that.
    """
    (change,) = helpers(["change"], source, target)
    lacking = [c for c in target.columns if c not in source.columns]
    whole = source.select(
        *[_col(c) for c in target.columns if c not in lacking],
        *[F.lit(None).cast(target.schema[c].dataType).alias(c) for c in lacking],
    )
    listed = None if types is None else list(types)
    scoped = target if listed is None else in_scope(target, listed, type_column)
    changes = change_set(whole, scoped, key, None, type_column, change)
    return changes.where(_col(change) == REMOVE).select(*[_col(c) for c in target.columns])


def _one_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The smallest row of each key, by a minimum that combines before the shuffle."""
    (row,) = helpers(["row"], df)
    whole = F.struct(*[_col(c) for c in df.columns])
    first = df.groupBy(*[_col(c) for c in key]).agg(F.min(whole).alias(row))
    return first.select(*[F.col(f"{row}.`{c}`").alias(c) for c in df.columns])
