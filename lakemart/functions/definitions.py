"""Helpers for searching a JSON definition inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nesting the JSON parser accepts; deeper text does not parse at all.
PARSER_DEPTH = 1000

# The parsed form of a document holds this many bytes at most.
PARSER_BYTES = 128 << 20

NODES = "array<struct<key:string,node:variant>>"

# Everything but brackets outside of texts; a text that never ends is taken to the end.
NO_BRACKET = r'"(?:[^"\\]++|\\.)*+"?|[^\[\]{}]'


def once(text: Column, test: Callable[[Column], Column]) -> Column:
    """A test that looks at a text several times and has it computed once.

    The optimizer moves filters below the projection a text comes from, where each
    mention of the text would compute it anew. Null where the text is null.
    """
    return F.exists(F.array(text), test)


def computed(docs: DataFrame, body: str) -> DataFrame:
    """The documents with their text computed once, for all filters and columns that look at it.

    The optimizer moves no filter below a generator, also none to the other side of a
    shuffle: where several branches read the same shuffled rows, they share one shuffle.
    """
    return docs.withColumn(body, F.explode(F.array(f"`{body}`")))


def has_keys(body: Column, *groups: Sequence[str]) -> Column:
    """A cheap test that never misses a document with all keys of one of the groups.

    A key can be spelled with escapes, so any backslash also counts as a maybe.
    """
    maybe = body.contains("\\")
    for keys in groups:
        every = [body.contains(f'"{key}"') for key in keys]
        maybe = maybe | reduce(and_, every)
    return maybe


def may_contain(body: Column, *groups: Sequence[str]) -> Column:
    """:func:`has_keys` of a text that may be expensive to compute."""
    return once(body, lambda b: has_keys(b, *groups))


def refusal(body: Column) -> Column:
    """Why the JSON parser takes no document in a text; meant for texts it has refused.

    ``too deep`` (nested beyond :data:`PARSER_DEPTH`), ``repeated key`` (JSON otherwise,
    refused by a session that does not allow it), ``too long``, or ``not JSON``.
    """
    brackets = F.regexp_replace(body, F.lit(NO_BRACKET), F.lit(""))
    step = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def deepen(state: Column, bracket: Column) -> Column:
        depth = state["depth"] + F.when(bracket.isin("[", "{"), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.greatest(state["most"], depth).alias("most"))

    deepest = F.aggregate(F.split(brackets, ""), step, deepen, lambda state: state["most"])
    readable = F.get_json_object(body, "$").isNotNull()
    return (
        F.when(F.octet_length(body) > PARSER_BYTES, "too long")
        .when(readable, "repeated key")
        .when((F.length(brackets) > PARSER_DEPTH) & (deepest > PARSER_DEPTH), "too deep")
        .otherwise("not JSON")
    )


def _children(found: Column) -> Column:
    members = F.transform(
        F.map_entries(F.try_variant_get(found["node"], "$", "map<string,variant>")),
        lambda m: F.struct(m["key"].alias("key"), m["value"].alias("node")),
    )
    elements = F.transform(
        F.try_variant_get(found["node"], "$", "array<variant>"),
        lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("node")),
    )
    return F.coalesce(members, elements, F.array().cast(NODES))


def find_nodes(node: Column, keys: Sequence[str]) -> Column:
    """(key, node) of the values stored under one of ``keys`` at any depth below ``node``.

    Walks level by level with ``aggregate``, all within the row. It goes as deep as
    needed (a level takes two characters of text at least), but copies what lies
    below each level.
    """
    nothing = F.array().cast(NODES)
    root = F.array(F.struct(F.lit(None).cast("string").alias("key"), node.alias("node")))
    start = F.struct(root.alias("level"), nothing.alias("hits"))

    def descend(state: Column, _: Column) -> Column:
        hits = F.filter(state["level"], lambda e: e["key"].isin(list(keys)))
        deeper = F.struct(
            F.flatten(F.transform(state["level"], _children)).alias("level"),
            F.concat(state["hits"], hits).alias("hits"),
        )
        return F.when(F.size(state["level"]) == 0, state).otherwise(deeper)

    depth = F.least(F.length(F.to_json(node)) / 2, F.lit(PARSER_DEPTH)).cast("int")
    levels = F.sequence(F.lit(0), depth + 1)
    return F.aggregate(levels, start, descend, lambda state: state["hits"])
