from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemart.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=3, positives=5, lows=(50, 95), most=3, scale=256):
    """All pairs, by the definition."""
    points = {}
    for id_, vector, label in rows:
        if id_ is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        entry = (label, [math.floor(scale * float(np.float32(x))) for x in vector])
        points[id_] = min(points.get(id_, entry), entry)
    out = []
    for anchor, (label, v) in points.items():
        if anchor % every:
            continue
        scores = [
            (-sum(a * b for a, b in zip(v, w, strict=True)), other, own == label)
            for other, (own, w) in points.items()
            if other != anchor and len(w) == len(v)
        ]
        first = sorted(s[:2] for s in scores if s[2])[:positives]
        others = sorted(s[:2] for s in scores if not s[2])
        for p, positive in first:
            found = [n for n in others if lows[0] * -p <= 100 * -n[0] <= lows[1] * -p][:most]
            out += [(anchor, positive, i + 1, n[1], -p, -n[0]) for i, n in enumerate(found)]
    return sorted(out)


def mined(spark, rows, every=3, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = negatives.mine(docs, F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def vectors(rng, n, size, kind):
    if kind == "clusters":
        heads = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(8)]
        return [[x + rng.gauss(0, 0.2) for x in rng.choice(heads)] for _ in range(n)]
    if kind == "copies":
        heads = [[rng.choice([0.0, 0.5, 1.0]) for _ in range(size)] for _ in range(4)]
        return [list(rng.choice(heads)) for _ in range(n)]
    return [[rng.gauss(0, 1) * rng.choice([0.01, 1, 5]) for _ in range(size)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "copies", "spread"])
@pytest.mark.parametrize("size", [1, 12])
def test_equals_all_pairs(spark, kind, size):
    rng = random.Random(size)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(vectors(rng, 260, size, kind))]
    want = plain(rows)
    assert mined(spark, rows, shard_rows=90, block_rows=30, leaf_rows=6) == want
    assert len(want) > 100 or size == 1


def test_odd_rows(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.1], 2), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 2),
            (6, [inf, 1.0], 2), (7, [float("nan"), 1.0], 1), (8, [1.0, 1.0], None), (None, [1.0, 0.0], 2), (9, [], 1), (12, [], 2),
            (15, [1.0], 1), (18, [1.0], 1), (21, [0.8], 2), (2, [0.9, 0.1], 2), (1, [1.0, 0.25], 1), (24, [-1.0, 0.0], 1)]
    assert mined(spark, rows) == plain(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, rows[3:8]) == plain(rows[3:8]) == []


def test_other_parameters_and_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(i, v, rng.randrange(3)) for i, v in enumerate(vectors(rng, 120, 6, "clusters"))]
    options = {"positives": 2, "negatives": 4, "lowest": 10, "highest": 80, "scale": 16}
    want = plain(rows, positives=2, most=4, lows=(10, 80), scale=16)
    assert mined(spark, rows, **options) == want != []
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "entry", "size", "shard", "block", "anchor", "vector", "rank", "score"):
        docs = docs.withColumn(name, F.lit("x"))
    found = negatives.mine(docs, F.col("vec_id") % 3 == 0, **options)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_large_scores(spark):
    """Beyond the whole numbers of a double the products are those of 64-bit integers."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(1, 1 << 20)) for _ in range(3)], i % 2) for i in range(60)]
    assert mined(spark, rows) == plain(rows) != []
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, [1e12], 1), (3, [1e12], 1)])


def test_the_tree_covers_its_points():
    rng = np.random.default_rng(0)
    x = np.r_[rng.integers(-300, 300, (500, 5)), np.tile([[3, 1, 2, 0, 9]], (200, 1)), np.zeros((3, 5), np.int64)]
    sphere, nodes = negatives.cover_tree(x, 10)
    assert sorted(np.concatenate([n.rows for n in nodes if n.rows is not None])) == list(range(len(x)))
    assert max(len(n.rows) for n in nodes if n.rows is not None) <= 10
    points = negatives.lifted(x, sphere) / sphere
    below = {}
    for i in range(len(nodes) - 1, -1, -1):
        own = [] if nodes[i].rows is None else list(nodes[i].rows)
        below.setdefault(i, []).extend(own)
        below.setdefault(nodes[i].parent, []).extend(below[i])
        away = np.linalg.norm(points[below[i]] - points[nodes[i].centre], axis=1)
        assert (2 * np.arcsin(np.minimum(away / 2, 1)) <= nodes[i].angle + 1e-9).all()


def test_descent_skips_what_cannot_matter():
    """On clustered points a search looks at a small part of the leaves."""
    rng = np.random.default_rng(1)
    heads = rng.normal(0, 200, (40, 8))
    x = np.floor(heads[rng.integers(0, 40, 4000)] + rng.normal(0, 6, (4000, 8))).astype(np.int64)
    sphere, nodes = negatives.cover_tree(x, 32)
    rows = [
        {"node": i, "parent": n.parent, "sphere": sphere, "angle": n.angle, "centre": x[n.centre],
         "ids": np.zeros(0, np.int64) if n.rows is None else n.rows, "vectors": x[[] if n.rows is None else n.rows].ravel()}
        for i, n in enumerate(nodes)
    ]
    tree = negatives.read_tree(rows, True)
    looked = []

    class Counted(dict):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    tree.leaves = Counted(tree.leaves)
    best = negatives.Best(5)
    negatives.descend([tree], x[7].astype(float), [best], 7)
    scores = sorted((-int(x[7] @ x[i]), i) for i in range(4000) if i != 7)[:5]
    assert best.found == scores
    assert len(looked) < len(tree.leaves) / 4
