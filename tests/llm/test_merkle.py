from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakemart.llm import merkle
from lakemart.llm.numbering import numbered

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """All levels of a tree, and the (sibling, left) path of each leaf."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            beside = place ^ 1
            paths[i].append((nodes[beside] if beside < len(nodes) else "", place % 2 == 1))
            at[i] = place // 2
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain(rows):
    """The tree by its definition."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, inner = {}, {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroots[g], inner[g] = climb([leaf(r) for r in groups[g]])
    if not order:
        return []
    root, upper = climb([subroots[g] for g in order])
    return [
        (row[0], leaf(row), subroots[g], root, inner[g][i] + upper[n])
        for n, g in enumerate(order)
        for i, row in enumerate(groups[g])
    ]


def proved(spark, rows, **options):
    found = merkle.prove(spark.createDataFrame(rows, SCHEMA), **options)
    return [
        (r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["sibling"], s["left"]) for s in r["path"]], r["verified"])
        for r in found.collect()
    ]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_equals_the_definition(spark, bits):
    rng = random.Random(bits)
    langs = [None, "", "a", "é", "zz", *[f"l{i}" for i in range(6)]]
    rows = [
        (rng.choice([None, i, i // 2, -i]), rng.choice([None, "", "é" * i, "x"]), rng.choice(langs[:3] if i % 3 else langs),
         rng.choice([None, "s"]), rng.choice([None, i]))
        for i in range(150)
    ]
    rows += rows[:20] * 2
    got = proved(spark, rows, block_bits=bits)
    assert by_text([g[:5] for g in got]) == by_text(plain(rows))
    assert all(g[5] for g in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_every_number_of_leaves(spark, n):
    rows = [(i, f"t{i}", "a", "s", i) for i in range(n)]
    assert by_text([g[:5] for g in proved(spark, rows, block_bits=2)]) == by_text(plain(rows))


def test_tampering_is_noticed_where_it_happens(spark):
    rows = [(i, "text", "ab"[i % 2], "s", None if i == 6 else i) for i in range(40)]
    wrong = F.col("doc_id") % 3 == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.prove(docs, claims={"n_chars": F.col("n_chars") + 1}, when=wrong, block_bits=2).collect()
    for r in found:
        # a null stays null, so nothing was changed there
        untouched = r["doc_id"] % 3 != 0 or r["doc_id"] == 6
        assert r["verified"] == untouched
        node = leaf(rows[r["doc_id"]][:4] + (rows[r["doc_id"]][4] + 1,)) if not untouched else r["leaf"]
        for s in r["path"]:
            node = digest(s["sibling"] + node if s["left"] else node + s["sibling"])
        assert node == r["folded_root"]
    assert len({r["root"] for r in found}) == 1


def test_empty_long_and_clashing(spark):
    assert proved(spark, []) == []
    rows = [(1, "long " * 400_000, "a", "s", 1), (2, None, None, None, None), (None, "", "a", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("group", "block", "path", "_tie", "number", "digest", "item", "leaf", "n"):
        docs = docs.withColumn(name, F.lit("x"))
    found = [tuple(r)[:4] for r in merkle.prove(docs).collect()]
    assert by_text(found) == by_text([p[:4] for p in plain(rows)])


def test_numbers_of_a_hot_group_are_made_in_many_tasks(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 5000).alias("k"),
    )
    got = numbered(rows, ["g"], ["k"], "numbers")
    want = {}
    for r in sorted(rows.collect()):
        want.setdefault(r["g"], []).append(r["k"])
    found = got.collect()
    assert len(found) == 5000
    assert all(want[r["g"]][r["number"]] == r["k"] for r in found)
    tasks = got.where("g = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert tasks > 1


def test_no_python_in_the_plan(spark):
    plan = merkle.prove(spark.createDataFrame([(1, "t", "a", "s", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
