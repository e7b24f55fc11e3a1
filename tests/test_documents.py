from __future__ import annotations

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from lakemart import operators as ops
from lakemart.functions import close_pairs
from lakemart.functions.rewriting import NOTEBOOK_ACTIVITY
from lakemart.functions.shapes import as_shape, shape_pattern, spaced

from helpers import physical_plan, row_set, rows

ITEMS = "id string, display_name string, type string"


def frame(spark, bodies):
    texts = [b if b is None or isinstance(b, str) else json.dumps(b) for b in bodies]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, body string")


def matches(tree, key):
    """Plain recursive definition of a search at any depth."""
    found = []
    if isinstance(tree, dict):
        for k, v in tree.items():
            found += [v] if k == key else []
            found += matches(v, key)
    elif isinstance(tree, list):
        for v in tree:
            found += matches(v, key)
    return found


def searched(docs, key, **options):
    found = ops.find_key(docs, key, **options).select("doc_id", F.to_json("value"))
    return sorted((i, json.dumps(json.loads(v), sort_keys=True)) for i, v in rows(found))


def expected(bodies, key):
    return sorted(
        (i, json.dumps(v, sort_keys=True))
        for i, body in enumerate(bodies)
        for v in matches(json.loads(body) if isinstance(body, str) else body, key)
    )


def random_tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, "text", None, True, 2.5, "ref", {}, []])
    if kind < 0.65:
        keys = rng.sample(["ref", "a", "b c", "d.e", "é"], rng.randrange(4))
        return {key: random_tree(rng, depth - 1) for key in keys}
    return [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_find_key_inside_matches_and_arrays(spark):
    bodies = [
        {"ref": {"ref": [1, {"ref": None}]}, "x": [{"ref": "s"}, [{"ref": {}}]]},
        [{"ref": 1}],
        {"Ref": 1, "ref2": 2},
        {"x": "\"ref\""},
        7,
    ]
    assert searched(frame(spark, bodies), "ref") == expected(bodies, "ref")


def test_find_key_ignores_what_is_not_json(spark):
    docs = frame(spark, ['{"ref":', "ref", None, "", '{"ref":1}'])
    assert searched(docs, "ref") == [(4, "1")]
    assert [r[0] for r in row_set(ops.malformed(docs).select("doc_id"))] == [0, 1, 3]


def test_find_key_takes_the_last_of_a_repeated_key(spark):
    body = '{"ref": 1, "x": {"a": 1, "a": {"ref": 2}}, "ref": 3}'
    assert searched(frame(spark, [body]), "ref") == [(0, "2"), (0, "3")]


def test_find_key_with_escaped_spelling(spark):
    assert searched(frame(spark, ['{"\\u0072ef": 1}']), "ref") == [(0, "1")]


@pytest.mark.parametrize("levels", [0, 1, 3, 12])
def test_find_key_equals_recursion_at_any_number_of_levels(spark, levels):
    rng = random.Random(5)
    bodies = [[random_tree(rng, 7)] for _ in range(60)]
    assert len(expected(bodies, "ref")) > 20
    assert searched(frame(spark, bodies), "ref", levels=levels) == expected(bodies, "ref")


def test_find_key_has_no_depth_limit_of_its_own(spark):
    deep = '{"ref":[' * 300 + "1" + "]}" * 300
    found = ops.find_key(frame(spark, [deep]), "ref")
    assert found.count() == 300


def test_find_replace_is_literal_ordered_and_per_environment(spark):
    docs = spark.createDataFrame(
        [(1, "dev", "a.c abc"), (2, "test", "a.c"), (3, "prod", "a.c"), (4, None, "a.c")],
        "doc_id int, env string, body string",
    )
    rules = [
        ("a.c", {"dev": "b.b", "test": "aa.cc", "prod": "a.c"}),
        ("b", {"dev": "z"}),
    ]
    assert row_set(ops.find_replace(docs, rules, "env").select("doc_id", "body")) == [
        (1, "z.z azc"),
        (2, "aa.cc"),
        (3, "a.c"),
        (4, "a.c"),
    ]
    with pytest.raises(ValueError):
        ops.find_replace(docs, [("", {"dev": "x"})], "env")


def test_find_replace_equals_the_rules_one_after_another(spark):
    """Rules that touch, contain and undo each other, over all environments."""
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("ab.$") for _ in range(rng.randint(low, high)))
    for _ in range(4):
        rules = [(word(1, 3), {e: word(0, 3) for e in "xyz" if rng.random() < 0.7}) for _ in range(6)]
        texts = [(i, rng.choice(["x", "y", "z", "other", "", None]), word(0, 30)) for i in range(200)]
        texts += [(len(texts), "x", None), (len(texts) + 1, "y", "")]
        expected = []
        for i, env, text in texts:
            for find, values in rules:
                if text is not None and env in values:
                    text = text.replace(find, values[env])
            expected.append((i, text))
        docs = spark.createDataFrame(texts, "doc_id int, env string, body string")
        found = ops.find_replace(docs, rules, "env").select("doc_id", "body")
        assert sorted(tuple(r) for r in found.collect()) == expected


def apply_pairs(value, pairs):
    for old, new in pairs:
        if old and value == old:
            value = new
    return value


def test_close_pairs_equals_applying_them_in_order():
    rng = random.Random(1)
    for _ in range(300):
        pairs = [(rng.choice("abcde "), rng.choice("abcde")) for _ in range(rng.randrange(8))]
        pairs = [(old.strip(), new) for old, new in pairs]
        closed = close_pairs(pairs)
        for value in "abcdef":
            assert closed.get(value, value) == apply_pairs(value, pairs)


@pytest.mark.parametrize("extra", [0, 100])
def test_swap(spark, extra):
    pairs = [("a", "b"), ("b", "c"), ("d", "a"), ("a", "z"), ("", "q")]
    pairs += [(f"x{i}", f"y{i}") for i in range(extra)]
    values = ["a", "b", "c", "d", "", "e", None, "x5"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = row_set(ops.swap(df, "v", pairs, alias="w"))
    assert got == sorted(((v, apply_pairs(v, pairs)) for v in values), key=str)


def test_resolve_pairs(spark):
    id1, id2 = "1" * 32, "2" * 32
    connections = spark.createDataFrame(
        [(id1, "one"), (id2, "two"), ("0" * 32, "two")], "connection_id string, connection_name string"
    )
    assert ops.resolve_pairs([("one", id2), ("", "two"), (id2, "two")], connections) == [
        (id1, id2),
        (id2, "0" * 32),
    ]
    assert ops.resolve_pairs([], connections) == []
    with pytest.raises(ValueError, match="no such connection"):
        ops.resolve_pairs([("one", "three")], connections)


def test_rewrite_array(spark):
    df = spark.createDataFrame(
        [(1, [("a", 1), ("b", 2)]), (2, [("t", 3)]), (3, []), (4, None), (5, [(None, 1)])],
        "k int, refs array<struct<id:string,n:int>>",
    )
    got = ops.rewrite_array(df, "refs", F.lit("t"))
    ids = got.select("k", F.transform("refs", lambda e: F.concat(e["id"], e["n"])), "updated")
    assert row_set(ids) == [
        (1, ["t1", "t2"], True),
        (2, ["t3"], False),
        (3, [], False),
        (4, None, False),
        (5, ["t1"], True),
    ]


# Fixed values in the shapes below: field names and tags of the definitions' format.
def linked(kind, artifact, workspace, **more):
    fields = {"artifactId": artifact, "workspaceId": workspace, **more}
    return {"linkedService": {"name": "x", "properties": {"type": kind, "typeProperties": fields}}}


def notebook(item, workspace):
    fields = {"notebookId": item, "workspaceId": workspace}
    return {"type": NOTEBOOK_ACTIVITY, "typeProperties": fields}


@pytest.fixture
def catalogs(spark):
    source = spark.createDataFrame(
        [("s-lake", "bronze", "Lakehouse"), ("s-wh", "dw", "Warehouse"), ("s-nb", "load", "Notebook"), ("s-old", "gone", "Lakehouse")],
        ITEMS,
    )
    target = spark.createDataFrame(
        [
            ("t-lake", "bronze", "Lakehouse", None), ("t-lake2", "bronze", "Lakehouse", None),
            ("t-wh", "dw", "Warehouse", "dw.host"), ("t-nb", "load", "Notebook", None),
            ("t-model", "gone", "SemanticModel", None),
        ],
        ITEMS + ", endpoint string",
    )
    return source, target


PIPELINES = [
    # 0: nested inside activities, a blob without artifact, an outer and an inner match
    {
        "properties": {
            "activities": [
                {
                    "type": "Copy",
                    "sink": linked("Lakehouse", "s-lake", "w-src"),
                    "source": {"linkedService": {"properties": {"type": "Blob", "typeProperties": {"containerUri": "u"}}}},
                    "externalReferences": {"connection": "A"},
                },
                {"type": "ForEach", "typeProperties": {"activities": [notebook("s-nb", "w-src")]}},
            ]
        }
    },
    # 1: warehouse with endpoint, inside another linked service
    {"linkedService": {"properties": {"type": "DataWarehouse", "typeProperties": {"artifactId": "s-wh", "workspaceId": "w-src", "endpoint": "old"}, "inner": linked("Lakehouse", "s-lake", "w-src")}}},
    # 2: already in the target workspace
    linked("Lakehouse", "t-lake", "w-tgt"),
    # 3: no counterpart
    {"a": [linked("Lakehouse", "s-old", "w-src"), linked("Lakehouse", "unknown", "w-src")]},
    # 4: chained connections, not of a string
    {"externalReferences": {"connection": "B"}, "x": {"externalReferences": {"connection": 5}}},
    # 5: nothing to do
    {"properties": {"activities": []}},
]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_rewrite_pipelines(spark, catalogs, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        check_rewrite_pipelines(spark, catalogs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_rewrite_pipelines(spark, catalogs):
    broken = '{"linkedService": {"artifactId":'
    docs = frame(spark, [*PIPELINES, broken, None])
    got = ops.rewrite_pipelines(docs, *catalogs, "w-tgt", [("A", "B"), ("B", "C")])
    result = {r["doc_id"]: r for r in got.collect()}
    assert len(result) == len(PIPELINES) + 2

    new = json.loads(result[0]["new_body"])["properties"]["activities"]
    assert new[0]["sink"] == linked("Lakehouse", "t-lake", "w-tgt")
    assert new[0]["source"] == PIPELINES[0]["properties"]["activities"][0]["source"]
    assert new[0]["externalReferences"] == {"connection": "C"}
    assert new[1]["typeProperties"]["activities"] == [notebook("t-nb", "w-tgt")]

    new = json.loads(result[1]["new_body"])["linkedService"]["properties"]
    assert new["typeProperties"] == {"artifactId": "t-wh", "workspaceId": "w-tgt", "endpoint": "dw.host"}
    assert new["inner"] == linked("Lakehouse", "t-lake", "w-tgt")

    assert result[3]["unresolved"] == ["Lakehouse:s-old", "Lakehouse:unknown"]
    assert json.loads(result[4]["new_body"])["externalReferences"] == {"connection": "C"}
    assert [result[i]["changed"] for i in range(8)] == [True, True, False, False, True, False, False, False]
    for i in (2, 3, 5):
        assert result[i]["new_body"] == json.dumps(PIPELINES[i])
    assert result[6]["error"] == "JSONDecodeError" and result[6]["new_body"] == broken
    assert result[7]["new_body"] is None


def test_rewrite_only_wanted_types(spark, catalogs):
    got = ops.rewrite_pipelines(frame(spark, PIPELINES), *catalogs, "w-tgt", types=["Notebook"])
    assert [r["changed"] for r in got.orderBy("doc_id").collect()] == [True] + [False] * 5


def test_rewriting_twice_changes_nothing_more(spark, catalogs):
    once = ops.rewrite_pipelines(frame(spark, PIPELINES), *catalogs, "w-tgt")
    again = ops.rewrite_pipelines(
        once.select("doc_id", F.col("new_body").alias("body")), *catalogs, "w-tgt"
    )
    assert again.where("changed").count() == 0


def test_rewriting_sees_escaped_keys(spark, catalogs):
    body = json.dumps(linked("Lakehouse", "s-lake", "w-src")).replace("artifactId", "artifact\\u0049d")
    got = ops.rewrite_pipelines(frame(spark, [body]), *catalogs, "w-tgt").first()
    assert json.loads(got["new_body"]) == linked("Lakehouse", "t-lake", "w-tgt")


def test_rewritten_keeps_key_order_and_unicode(spark, catalogs):
    doc = {"z": 1, "a": "é", **linked("Lakehouse", "s-lake", "w-src"), "n": 12345678901234567890}
    got = ops.rewrite_pipelines(frame(spark, [doc]), *catalogs, "w-tgt").first()["new_body"]
    assert list(json.loads(got)) == ["z", "a", "linkedService", "n"]
    assert json.loads(got)["n"] == 12345678901234567890
    assert json.loads(got)["a"] == "é"


SHAPE = """linkedService struct<name: string, properties: struct<type: string,
        typeProperties: struct<artifactId: string, workspaceId: string, endpoint: string,
            linkedService: struct<properties: struct<type: string,
                typeProperties: struct<artifactId: string, workspaceId: string, endpoint: string>>>>,
        n: bigint, on: boolean>>,
    activities array<struct<type: string not null,
        typeProperties: struct<notebookId: string, workspaceId: string,
            activities: array<struct<type: string, typeProperties: struct<notebookId: string, workspaceId: string>>>>,
        externalReferences: struct<connection: string>>>,
    tags array<array<string>>"""


def random_pipeline(rng):
    def maybe(**fields):
        return {k: v for k, v in fields.items() if rng.random() < 0.8}

    def service(inner):
        kind = rng.choice(["Lakehouse", "DataWarehouse", "Blob"])
        place = maybe(artifactId=rng.choice(["s-lake", "s-wh", "none", "t,:x"]), workspaceId=rng.choice(["w-src", "w-tgt"]))
        if kind == "DataWarehouse":
            place |= {"endpoint": "old, host: 1"}
        if inner and rng.random() < 0.5:
            place |= {"endpoint": "e", "linkedService": service(False)}
        properties = maybe(type=kind, typeProperties=place)
        if not inner:
            return {"properties": properties}
        return maybe(name="x") | {"properties": properties | maybe(n=rng.choice([0, -7, 10**17]), on=True)}

    def activity(depth):
        place = maybe(notebookId=rng.choice(["s-nb", "none"]), workspaceId=rng.choice(["w-src", "w-tgt"]))
        if depth and rng.random() < 0.5:
            place["activities"] = [activity(0) for _ in range(rng.randrange(3))]
        found = {"type": rng.choice([NOTEBOOK_ACTIVITY, "Copy"]), "typeProperties": place}
        if depth and rng.random() < 0.5:
            found["externalReferences"] = maybe(connection=rng.choice(["A", "B", "C", "a: b, c"]))
        return found

    return maybe(
        linkedService=service(True),
        activities=[activity(1) for _ in range(rng.randrange(4))],
        tags=[["a", "b,c"], [], ["]"]],
    )


def test_known_shape_gives_the_same_as_the_tree_walk(spark, catalogs):
    rng = random.Random(3)
    texts = []
    for i in range(300):
        tree = random_pipeline(rng)
        texts.append(json.dumps(tree, **[{}, {"indent": 2}, {"separators": (",", ":")}][i % 3]))
        if i % 5 == 0:  # what the shape does not cover
            odd = [{**tree, "more": 1}, {"z": 0, **tree}, [tree], {**tree, "tags": [["é"]]}, {**tree, "tags": None}]
            texts.append(json.dumps(odd[i // 5 % 5]))
            texts.append(texts[-2][:-1] + ",}")
            texts.append(texts[-3] + " tail")
    docs = frame(spark, texts)
    pattern = shape_pattern(as_shape(SHAPE))
    fitting = docs.where(F.col("body").rlike(pattern)).count()
    assert fitting == sum(fits(t) for t in texts) and 290 <= fitting <= 310
    plain = ops.rewrite_pipelines(docs, *catalogs, "w-tgt", [("A", "B"), ("B", "C")])
    typed = ops.rewrite_pipelines(docs, *catalogs, "w-tgt", [("A", "B"), ("B", "C")], shape=SHAPE)
    assert as_json(typed) == as_json(plain)
    assert typed.where("changed").count() > 100 and typed.where("size(unresolved) > 0").count() > 50
    only = ops.rewrite_pipelines(docs, *catalogs, "w-tgt", types=["Notebook"], shape=SHAPE)
    assert as_json(only) == as_json(ops.rewrite_pipelines(docs, *catalogs, "w-tgt", types=["Notebook"]))


def as_json(df):
    """Rows with the new text read where it is JSON: an added field may stand elsewhere."""
    found = []
    for r in df.collect():
        tree = json.loads(r["new_body"]) if r["changed"] else r["new_body"]
        spaced = not r["changed"] or r["new_body"] == json.dumps(tree)
        found.append((r["doc_id"], json.dumps(tree, sort_keys=True), spaced, r["unresolved"], r["error"]))
    return sorted(found)


def fits(text):
    try:
        tree = json.loads(text)
    except json.JSONDecodeError:
        return False
    names = ["linkedService", "activities", "tags"]
    if not isinstance(tree, dict) or list(tree) != [n for n in names if n in tree] or "\\" in text:
        return False
    return tree.get("tags", []) is not None


@pytest.mark.parametrize("numbers", [False, True])
def test_blanks_go_behind_commas_and_colons_outside_of_texts(spark, numbers):
    rng = random.Random(5)

    def text():
        return "".join(rng.choice('ab:,{}[]"\\ ') for _ in range(rng.randrange(6)))

    def member():
        return {k: text() for k in ("a", "b") if rng.random() < 0.7}

    trees = [{"t": text(), "l": [text() for _ in range(rng.randrange(4))], "o": [member() for _ in range(3)], "m": [[text()], [text()]]} for _ in range(3000)]
    # nothing that needs a closer look
    trees += [{"t": "a: b, c", "l": ["x", "y,z"], "o": [{"a": "}, {"}, {"b": "1"}], "m": [["a"]]}] * 2
    shape = "t string, l array<string>, o array<struct<a: string, b: string>>, m array<array<string>>"
    if numbers:
        shape, trees = shape + ", n array<bigint>", [{**t, "n": [1, -2, 3]} for t in trees]
    docs = frame(spark, [json.dumps(t, separators=(",", ":")) for t in trees])
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", spaced(F.col("body"), as_shape(shape)).alias("s")).collect()}
    assert [got[i] for i in range(len(trees))] == [json.dumps(t) for t in trees]


def test_documents_of_the_shape_stay_in_the_jvm(spark, catalogs):
    """Those that fit are filtered out in front of Python."""
    docs = frame(spark, [json.dumps(random_pipeline(random.Random(i))) for i in range(5)])
    plan = physical_plan(ops.rewrite_pipelines(docs, *catalogs, "w-tgt", shape=SHAPE))
    assert plan.count("ArrowEvalPython") == 1
    below = plan[plan.index("ArrowEvalPython") :]
    assert "NOT RLIKE(" in below.split("ArrowEvalPython")[1]


@pytest.mark.parametrize("shape", ["a double", "`a\"b` string", "linkedService struct<properties: struct<type: string, typeProperties: struct<artifactId: string>>>"])
def test_shapes_that_cannot_be_edited_are_refused(spark, catalogs, shape):
    with pytest.raises(ValueError):
        ops.rewrite_pipelines(frame(spark, ["{}"]), *catalogs, "w-tgt", shape=shape)


def test_ids_with_escapes(spark, catalogs):
    source, target = catalogs
    odd = 'a"b\\c'
    source = source.unionByName(spark.createDataFrame([(odd, "bronze", "Lakehouse")], ITEMS))
    got = ops.rewrite_pipelines(frame(spark, [json.dumps(linked("Lakehouse", odd, "w-src"))]), source, target, "w-tgt")
    assert json.loads(got.first()["new_body"]) == linked("Lakehouse", "t-lake", "w-tgt")


def attached(name, workspace, known=None, default="old"):
    lake = {"default_lakehouse": default, "default_lakehouse_name": name, "default_lakehouse_workspace_id": workspace}
    if known is not None:
        lake["known_lakehouses"] = [{"id": k} for k in known]
    return {"metadata": {"dependencies": {"lakehouse": lake}}, "cells": [1]}


def test_repair_notebooks(spark, catalogs):
    bodies = [
        attached("bronze", "w-src", ["old", "other"]),
        attached("bronze", "w-src"),
        attached("bronze", "w-tgt", ["t-lake"], default="t-lake"),
        attached("bronze", "w-tgt", ["t-lake", "old"], default="t-lake"),
        attached("", "w-src", ["old"]),
        {"metadata": {"dependencies": {"lakehouse": None}}},
        {"metadata": {"dependencies": {"warehouse": {"default_warehouse": "s-wh", "known_warehouses": [{"id": "s-wh", "type": "DW"}, {"id": "z"}]}}}},
        {"metadata": {}},
        {"metadata": {"dependencies": {"warehouse": {"default_warehouse": "t-wh", "known_warehouses": []}}}},
    ]
    source, target = catalogs
    got = ops.repair_notebooks(frame(spark, bodies), source, target, "w-tgt")
    result = got.orderBy("doc_id").collect()
    assert [r["changed"] for r in result] == [True, True, False, True, False, False, True, False, False]
    new = [json.loads(r["new_body"]) for r in result]
    assert new[0] == attached("bronze", "w-tgt", ["t-lake", "t-lake"], default="t-lake")
    assert new[1] == attached("bronze", "w-tgt", default="t-lake")
    assert new[3] == attached("bronze", "w-tgt", ["t-lake", "t-lake"], default="t-lake")
    assert new[6]["metadata"]["dependencies"]["warehouse"] == {
        "default_warehouse": "t-wh",
        "known_warehouses": [{"id": "t-wh", "type": "DW"}, {"id": "z"}],
    }
    for i in (2, 4, 5, 7, 8):
        assert result[i]["new_body"] == json.dumps(bodies[i])


def test_package_only_changed_on_one_line(spark):
    long = json.dumps({"text": "é" * 200})
    docs = spark.createDataFrame(
        [(1, "{}", long), (2, "{}", "{}"), (3, "{}", None)], "doc_id int, body string, new_body string"
    )
    packed = ops.package(docs, request="request").collect()
    assert [r["doc_id"] for r in packed] == [1]
    assert packed[0]["payload"] == base64.b64encode(long.encode("utf-8")).decode()
    # fixed values: field names of an update request
    assert json.loads(packed[0]["request"]) == {
        "definition": {
            "parts": [
                {
                    "path": "pipeline-content.json",
                    "payload": packed[0]["payload"],
                    "payloadType": "InlineBase64",
                }
            ]
        }
    }


def test_rewriting_needs_no_key(spark, catalogs):
    """Null, repeated and missing keys don't matter; source ids with several names take the smallest."""
    source, target = catalogs
    source = source.unionByName(spark.createDataFrame([("s-lake", "dw2", "Lakehouse"), ("s-lake", "bronze", "x")], ITEMS))
    target = target.unionByName(spark.createDataFrame([("a-first", "dw2", "Lakehouse", None)], target.schema))
    body = json.dumps(linked("Lakehouse", "s-lake", "w-src"))
    docs = spark.createDataFrame([(None, body), (None, body), (1, body), (1, "{}")], "doc_id int, body string")
    got = ops.rewrite_pipelines(docs, source, target, "w-tgt")
    assert sorted(r["changed"] for r in got.collect()) == [False, True, True, True]
    new = {r["new_body"] for r in got.where("changed").collect()}
    assert [json.loads(t)["linkedService"]["properties"]["typeProperties"]["artifactId"] for t in new] == ["a-first"]
    alone = ops.rewrite_pipelines(docs.select("body"), source, target, "w-tgt")
    assert alone.columns == ["body", "new_body", "changed", "unresolved", "error"]
    assert alone.where("changed").count() == 3


def test_one_odd_pipeline_does_not_end_the_job(spark, catalogs):
    half = json.dumps(linked("Lakehouse", "\ud800", "w-src"))
    odd = [half, json.dumps({"activities": [7, None, "notebookId"]}), '{"linkedService": {"artifactId": 1}} tail']
    good = json.dumps(linked("Lakehouse", "s-lake", "w-src"))
    got = ops.rewrite_pipelines(frame(spark, [*odd, good]), *catalogs, "w-tgt").collect()
    result = {r["doc_id"]: r for r in got}
    assert result[0]["unresolved"] == ["Lakehouse:\\ud800"] and result[0]["error"] is None
    assert not result[1]["changed"] and result[1]["error"] is None
    assert result[2]["error"] == "JSONDecodeError"
    assert result[3]["changed"]


@pytest.mark.parametrize("known", [["abc"], [None], 7, {"id": "x"}, "text"])
def test_one_odd_notebook_does_not_end_the_job(spark, catalogs, known):
    odd = attached("bronze", "w-src")
    odd["metadata"]["dependencies"]["lakehouse"]["known_lakehouses"] = known
    warehouse = {"metadata": {"dependencies": {"warehouse": {"default_warehouse": "s-wh", "known_warehouses": known}}}}
    good = attached("bronze", "w-src", ["old"])
    docs = frame(spark, [odd, warehouse, good])
    result = {r["doc_id"]: r for r in ops.repair_notebooks(docs, *catalogs, "w-tgt").collect()}
    assert [result[i]["changed"] for i in range(3)] == [True] * 3
    assert json.loads(result[0]["new_body"])["metadata"]["dependencies"]["lakehouse"]["known_lakehouses"] == known
    assert all(result[i]["error"] is None for i in range(3))


def test_notebooks_report_errors_and_what_is_unresolved(spark, catalogs):
    text = json.dumps(attached("bronze", "w-src"))
    gone = {"metadata": {"dependencies": {"warehouse": {"default_warehouse": "nobody's"}}}}
    docs = frame(spark, [text + " tail", text[:-3], attached("unknown", "w-src"), gone, None, "not json"])
    result = {r["doc_id"]: r for r in ops.repair_notebooks(docs, *catalogs, "w-tgt").collect()}
    assert [result[i]["error"] for i in range(6)] == ["JSONDecodeError"] * 2 + [None] * 4
    assert result[2]["unresolved"] == ["Lakehouse:unknown"] and result[3]["unresolved"] == ["Warehouse:nobody's"]
    assert not any(r["changed"] for r in result.values())
    again = ops.repair_notebooks(frame(spark, [attached("bronze", "w-src")]), *catalogs, "w-tgt")
    twice = ops.repair_notebooks(again.select("doc_id", F.col("new_body").alias("body")), *catalogs, "w-tgt")
    assert [(r["changed"], r["unresolved"]) for r in twice.collect()] == [(False, [])]


def test_find_key_with_several_keys(spark):
    rng = random.Random(8)
    bodies = [[random_tree(rng, 6)] for _ in range(40)]
    found = ops.find_key(frame(spark, bodies), ["ref", "a"], key_alias="key")
    assert found.columns == ["doc_id", "key", "value"]
    for key in ("ref", "a"):
        own = found.where(F.col("key") == key).select("doc_id", F.to_json("value"))
        got = sorted((i, json.dumps(json.loads(v), sort_keys=True)) for i, v in rows(own))
        assert got == expected(bodies, key)


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_find_key_accounts_for_every_document(spark, allowed):
    deep = '{"ref":[' * 1200 + "1" + "]}" * 1200
    texts = [deep, '{"ref":1}', '{"ref":1,"ref":2}', '{"ref":', '{"x":"[[[\\"ref\\""}', '{"x":1}', None,
             '{"ref":"' + "[" * 1200 + '"}', "[" * 1200 + '"ref"']
    session = spark.newSession()
    session.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
    docs = frame(session, texts)
    found = ops.find_key(docs, "ref", error_alias="error")
    assert found.columns == ["doc_id", "value", "error"]
    errors = {r[0]: r[1] for r in found.where("error is not null").select("doc_id", "error").collect()}
    values = {r[0]: r[1] for r in found.where("error is null").select("doc_id", F.to_json("value")).collect()}
    repeated = {} if allowed == "true" else {2: "repeated key"}
    assert errors == {0: "too deep", 3: "not JSON", 8: "too deep"} | repeated
    assert values == {1: "1", 7: '"' + "[" * 1200 + '"'} | ({2: "2"} if allowed == "true" else {})
    # without the column the refused ones are left out, and malformed lists them
    assert {r["doc_id"] for r in ops.find_key(docs, "ref").collect()} == set(values)
    listed = ops.malformed(docs, reason="why")
    assert {r["doc_id"]: r["why"] for r in listed.collect()} == errors


def test_errors_come_from_the_same_parse(spark):
    found = ops.find_key(frame(spark, ['{"ref":1}']), ["ref", "id"], key_alias="key", error_alias="error")
    plan = physical_plan(found)
    assert plan.count("parseJson") == 1 and "Exchange" not in plan


def test_helper_names_do_not_collide(spark, catalogs):
    """Operators on tables with names like those they use, and on their own output."""
    names = ["_node", "_hits", "_pos", "_name", "_child", "_digest", "_own", "_edited", "_from", "_to", "_value",
             "_key0", "_salt", "_found", "_type", "_lakehouse", "_old_warehouse", "_model", "new_id", "_FIELDS"]
    body = json.dumps({"ref": 1, **linked("Lakehouse", "s-lake", "w-src")})
    docs = spark.createDataFrame([(1, body, *names)], ", ".join(["doc_id int", "body string", *[f"{n} string" for n in names]]))
    docs = docs.withColumn("name", F.lit("bronze")).withColumn("item", F.lit("s-lake"))
    source, target = catalogs
    steps = [
        lambda df: ops.swap(df, "_from", [(str(i), "x") for i in range(60)] + [("_from", "y")]),
        lambda df: ops.lookup(df, target, {"name": "display_name"}),
        lambda df: ops.rebind(df, "item", source, target),
        lambda df: ops.resolve_ref(df, "name", target),
        lambda df: ops.resolve_tokens(df, "name", target, "w"),
        lambda df: ops.rewrite_pipelines(df, source, target, "w-tgt"),
        lambda df: ops.repair_notebooks(df, source, target, "w-tgt"),
    ]
    for step in steps:
        once = step(docs)
        twice = step(once)
        assert once.count() == twice.count() == 1
        assert twice.columns == once.columns
        assert set(names) <= set(once.columns)
        kept = [n for n in names if n not in ("_from", "new_id")]
        assert twice.select(kept).first() == docs.select(kept).first()
    found = ops.find_key(docs, "ref")
    assert found.columns == [c for c in docs.columns if c != "body"] + ["value"] and found.count() == 1
