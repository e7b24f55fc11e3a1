"""SimHash links and components against all-pairs comparison."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lakemart.llm import simhash
from lakemart.llm.components import connected_components, large_star, local_roots


def brute_fingerprint(text):
    words = bytes((text or "").encode()).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(items):
    """Smallest id per row by flooding over links of at most three bits."""
    prints = [brute_fingerprint(t) for _, t in items]
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc_id, _), at in zip(items, label, strict=True):
        least.setdefault(at, []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(
        ((i, f"{p:016x}", least[at]) for (i, _), p, at in zip(items, prints, label, strict=True)), key=str
    )


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 150]))) for _ in range(40)]
    items = []
    for i in range(160):
        words = rng.choice(texts).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        items.append((i * 3, " ".join(words)))
    items += [(900, None), (901, ""), (None, "  \n"), (902, "ONE"), (903, "one"), (903, "one"), (904, "a B"), (5, "x " * 5000)]
    items += [(None, "nobody else has this text")]
    return items


def test_components_equal_brute_force(docs_of):
    items = corpus()
    found = simhash.near_duplicates(docs_of(items))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_components(items)


def test_hot_blocks_give_the_same_links(docs_of):
    items = corpus()
    found = simhash.near_duplicates(docs_of(items), hot=2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_components(items)


def test_trie_pairs_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 48, (400, 3)).astype(np.uint64)
    keys = np.unique(base[rng.integers(0, 5, 400)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    group = keys >> np.uint64(48)
    a, b = simhash.close_pairs(keys, group, 16, 3)
    found = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    wanted = {
        (i, j)
        for j in range(len(keys))
        for i in range(j)
        if group[i] == group[j] and int(keys[i] ^ keys[j]).bit_count() <= 3
    }
    assert found == wanted and len(a) == len(found) > 50


def test_contracted_pairs_connect_the_same(monkeypatch):
    monkeypatch.setattr(simhash, "FOUND_AT_ONCE", 50)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 20)
    rng = np.random.default_rng(6)
    flips = np.uint64(1) << rng.integers(0, 20, (300, 2)).astype(np.uint64)
    keys = np.unique((np.uint64(7) << np.uint64(40)) ^ flips[:, 0] ^ flips[:, 1])
    whole = simhash.close_pairs(keys, np.zeros(len(keys), int), 16, 3)
    some = simhash.close_pairs(keys, np.zeros(len(keys), int), 16, 3, contract=True)
    assert len(whole[0]) > 1000 > len(some[0])
    roots = [local_roots(a, b, len(keys)).tolist() for a, b in (whole, some)]
    assert roots[0] == roots[1]


def test_keep_first(docs_of):
    items = corpus()
    kept = simhash.keep_first(docs_of(items))
    assert kept.columns == ["doc_id", "text", "source"]
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    wanted = {c for i, _, c in brute_components(items) if i is not None} | {None}
    assert ids == sorted(wanted, key=str)


def test_keep_first_with_an_id_in_several_groups(docs_of):
    """Ids say nothing about texts: each group keeps its own first row."""
    words = [f"w{i}" for i in range(400)]
    near, far = " ".join(words), " ".join(reversed(words))
    a, b = near + " end", "something else entirely here"
    assert simhash_bits(docs_of, near, a) <= 3 < simhash_bits(docs_of, near, far)
    rows = [(5, near), (7, a), (7, far), (7, b), (9, b), (7, b), (None, "only here"), (None, "only here"), (None, near)]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(docs_of(rows)).collect() if r["doc_id"] is not None)
    assert kept == sorted([(5, near), (7, far), (7, b)])
    assert [r["text"] for r in simhash.keep_first(docs_of(rows)).where("doc_id is null").collect()] == ["only here"]


def simhash_bits(docs_of, one, two):
    found = simhash.near_duplicates(docs_of([(1, one), (2, two)])).collect()
    a, b = (int(r["fingerprint"], 16) for r in found)
    return (a ^ b).bit_count()


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    assert simhash.keep_first(docs_of([])).collect() == []


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    edges += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(3000, 3000), (None, 5), (1, 0)]
    edges += [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(250)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if None not in (a, b) and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    frame = spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)
    assert {r["node"]: r["root"] for r in connected_components(frame).collect()} == label


def test_clashing_columns(spark):
    names = "doc_id bigint, text string, print string, component_id int, fingerprint int, _rank int, _COMPONENT int, t int, r int"
    docs = spark.createDataFrame([(i, "the same words here", "p", 1, 2, 3, 4, 5, 6) for i in (7, 3, 3)], names)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [3]
    assert simhash.near_duplicates(docs).count() == 3


def test_hot_nodes_of_components_are_split(spark, tmp_path):
    """A third of all nodes hang on one: no task gets all of its edges."""
    n = 600_000
    edges = spark.range(1, n).select(F.col("id").alias("u"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - 1).alias("v"))
    edges.repartition(16).write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
    }
    old = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        step = large_star(edges)
        counted = step.agg(F.count("*"), F.max("v"))
        assert counted.collect()[0][0] > 0
        assert "skew=true" in counted._jdf.queryExecution().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
