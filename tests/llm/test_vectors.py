"""Links and components of vectors against comparing all pairs; recall of the graph."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lakemart.llm import vectors


def brute(rows, near=0.98):
    """(id, links, smallest reachable id, kept) per row."""
    n = len(rows)

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64) / max(map(abs, v))
        return x / np.sqrt((x * x).sum())

    units = [None if label is None else unit(v) for _, v, label in rows]
    near_to = [
        [
            j
            for j in range(n)
            if j != i
            and units[i] is not None
            and units[j] is not None
            and rows[i][2] == rows[j][2]
            and len(units[i]) == len(units[j])
            and units[i] @ units[j] >= near
        ]
        for i in range(n)
    ]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near_to[i]:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    return sorted(
        ((rows[i][0], len(near_to[i]), least.get(root[i]), rows[i][0] == least.get(root[i])) for i in range(n)), key=str
    )


def corpus(seed=0, size=250):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(size):
        v = centres[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.3])
        rows.append((1000 + 7 * i, (v * rng.choice([1.0, 3.0])).tolist(), int(rng.integers(3))))
    rows += [(5, rows[0][1], rows[0][2]), (5, rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2])]
    rows += [(6, None, 1), (7, [], 1), (8, [0.0] * 16, 1), (9, [1.0] * 15 + [None], 1), (10, [float("nan")] * 16, 1)]
    rows += [(11, [float("inf")] + [1.0] * 15, 1), (12, rows[2][1], None), (13, [1.0, 2.0], 1), (14, [2.0, 4.0], 1)]
    rows += [(15, [1e200] * 16, 2), (16, [1e-200] * 16, 2), (None, [5.0, -3.0, 1.0], 0), (None, None, None)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 20, "query_rows": 30}])
def test_rows_equal_brute_force(spark, sizes):
    rows = corpus()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = vectors.near_duplicates(frame, **sizes)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_recall_on_the_table(spark, small_dir):
    """The table's vectors and disturbed copies of them, since it has few near-duplicates itself."""
    where = small_dir.replace("sf0.001", "sf0.1")
    rng = np.random.default_rng(0)
    rows = []
    for r in spark.read.parquet(f"{where}/embeddings.parquet").orderBy("vec_id").collect():
        v = np.array(r["embedding"])
        size = rng.choice([0.0, 0.02, 0.1]) * np.sqrt(v @ v / len(v))
        rows += [(10 * r["vec_id"] + n, (v + n * size * rng.normal(size=len(v))).tolist(), r["label"]) for n in range(3)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = {r["vec_id"]: r for r in vectors.near_duplicates(frame).collect()}
    assert len(found) == len(rows)
    by_label = {}
    for i, v, label in rows:
        by_label.setdefault(label, []).append((i, np.array(v, np.float32).astype(float)))
    true = got = 0
    for items in by_label.values():
        x = vectors.unit(np.array([v for _, v in items]))
        links = (x @ x.T >= 0.98).sum(axis=1) - 1
        for (i, _), n in zip(items, links, strict=True):
            assert found[i]["n_links"] <= n
            true, got = true + n, got + found[i]["n_links"]
    assert true > 1000 and got >= 0.98 * true


@pytest.mark.parametrize("crowd", [1, 300])
def test_graph_recall(crowd):
    """With clusters far larger than a node has links, too."""
    rng = np.random.default_rng(crowd)
    centres = rng.normal(size=(3000 // crowd, 32))
    x = np.repeat(centres, crowd, axis=0) + rng.normal(size=(len(centres) * crowd, 32)) * 0.05
    shard = vectors.Shard(x)
    u = vectors.unit(x)
    true = u @ u.T >= 0.98
    got = sum(len(i) for _, i, _, _ in shard.links_of(x))
    assert got >= 0.98 * true.sum()


def test_audit_widens_the_beam(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    monkeypatch.setattr(vectors.Graph, "near", lambda self, q, beam: (np.full((len(q), 1), -1), np.full((len(q), 1), -np.inf)))
    assert vectors.Shard(x, near=0.8).beam >= 400  # a graph that finds nothing: all is compared


def only_one(node, sim, beam):
    """A beam with one place taken."""
    nodes, sims = np.full((len(node), beam), -1), np.full((len(node), beam), -np.inf)
    nodes[:, 0], sims[:, 0] = node, np.where(node >= 0, sim, -np.inf)
    return nodes, sims


def rare_pairs(n, pairs):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 16))
    x[:pairs] = x[pairs : 2 * pairs] + rng.normal(size=(pairs, 16)) * 0.02
    return x


def test_audit_is_not_satisfied_by_what_a_node_says_of_itself(monkeypatch):
    """Few nodes have a partner, and the graph finds each node and nothing else."""

    def itself(self, q, beam):
        sims = q @ self.x.T
        return only_one(np.argmax(sims, axis=1), np.max(sims, axis=1), beam)

    monkeypatch.setattr(vectors.Graph, "near", itself)
    x = rare_pairs(2000, 60)
    shard = vectors.Shard(x)
    assert shard.beam >= 2000
    assert sum((i + at != j).sum() for at, i, j, _ in shard.links_of(x)) == 120


def test_audit_covers_queries_of_other_shards(monkeypatch):
    """A graph that knows its own nodes only by heart is found out by queries from elsewhere."""
    x = rare_pairs(1200, 400)
    inside, outside = x[400:], x[:400]

    def by_heart(self, q, beam):
        sims = q @ self.x.T
        best, top = np.argmax(sims, axis=1), np.max(sims, axis=1)
        return only_one(np.where(top > 0.999999, best, -1), top, beam)

    monkeypatch.setattr(vectors.Graph, "near", by_heart)
    shard = vectors.Shard(inside)
    assert shard.beam < 800  # within the shard nothing has a partner, so nothing is missed
    assert sum(len(i) for _, i, _, _ in shard.links_of(outside)) >= 400 * 0.99
    assert shard.beam >= 800


def test_empty_table_and_clashing_columns(spark):
    schema = "vec_id bigint, embedding array<float>, label int, node int, links int, first int"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 2.0], 3, 0, 0, 0), (2, [1.0, 2.0], 3, 0, 0, 0)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_pairs_count_for_both_sides(spark):
    """Found by either side or both; beside a widened search's count of a shard nothing is added."""
    rows = [
        # 1 (shard 0, 2 copies) and 2 (shard 1, 3 copies): found from 1 only
        (1, 2, 3, 2, 1, 0),
        # 3 and 4: found from both
        (3, 4, 1, 1, 0, 0), (4, 3, 1, 1, 0, 0),
        # 5 (shard 1) found 6 (shard 0); 6 counted 7 links in shard 1, that one among them, and found 8 in shard 0
        (5, 6, 1, 1, 0, 1), (6, None, 7, None, 1, None), (6, 8, 2, 1, 0, 0),
        # a pair that connects
        (9, 1, None, None, None, None),
    ]
    found = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in vectors.FOUND))
    links = {r["node"]: r["links"] for r in vectors._link_counts(found).collect()}
    assert links == {1: 3, 2: 2, 3: 1, 4: 1, 5: 1, 6: 9, 8: 1}


@pytest.mark.parametrize("shard_rows", [100_000, 150])
def test_links_are_symmetric(spark, shard_rows):
    """Links are symmetric, within a shard and between shards."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 16))
    x[:250] = x[250:500] + rng.normal(size=(250, 16)) * 0.02
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in vectors.near_duplicates(frame, shard_rows=shard_rows).collect()}
    u = vectors.unit(x)
    true = (u @ u.T >= 0.98) & ~np.eye(600, dtype=bool)
    for a, b in zip(*np.nonzero(true), strict=True):
        assert (found[int(a)]["n_links"] > 0) == (found[int(b)]["n_links"] > 0)
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * true.sum()
