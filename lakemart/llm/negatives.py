"""Hard negatives: for an anchor and a positive, what scores just below the positive under another label.

Candidates are dealt to shards, and each shard has a cover tree per label. Vectors get one
more component that brings them all to the norm of the longest, so that they lie on a sphere
and an inner product with a query depends on the angle alone. A node covers its points within
an angle that shrinks from level to level; with the angle between query and centre that
bounds the inner products below it from both sides. The descent takes the node with the
highest bound first and skips nodes that cannot reach what is already found, or that lie
outside of all windows of scores asked for. Scores of the points in leaves are exact.

Trees are built once and written as a table with a row per node; the searches for positives
and for negatives read it. Queries come in blocks, every block to every shard, and a task
holds the trees of one shard. The best of each shard are merged by Spark.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, col, shuffle_partitions, tidy_after, written

by_value(__name__)

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95
SHARD_ROWS = 16_384
BLOCK_ROWS = 16_384
LEAF_ROWS = 128
# How much the covering angle shrinks from a level to the next.
SHRINK = 0.7
# Centres tried at a node; points that none of them covers stay leaves of the node itself.
CENTRES = 64
# Leaves whose scores are looked at together: one at first, then twice as many each time.
LEAVES_AT_ONCE = 16

NODE = "size int, label bigint, node bigint, parent bigint, sphere double, angle double, centre array<bigint>, ids array<bigint>, vectors array<bigint>"


# --- the tree ----------------------------------------------------------------


def _fits(norms: np.ndarray) -> None:
    if len(norms) and norms.max() >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit into 64 bits")


def lifted(vectors: np.ndarray, sphere: float) -> np.ndarray:
    """Vectors of one norm: a further component makes up for what is missing."""
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(sphere * sphere - (x * x).sum(axis=1), 0))
    return np.c_[x, rest]


@dataclass
class Node:
    parent: int
    angle: float
    centre: int
    rows: np.ndarray | None = None


def cover_tree(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[float, list[Node]]:
    """The radius of the sphere, and the nodes of a tree over the vectors, parents first."""
    x = vectors.astype(np.float64)
    norms = (x * x).sum(axis=1)
    _fits(norms)
    sphere = math.sqrt(norms.max())
    points = lifted(vectors, sphere) / (sphere or 1)
    nodes: list[Node] = []

    def angles(centre: int, rows: np.ndarray) -> np.ndarray:
        # from the chord, which is exact where an arc cosine is not: between near points
        chord = np.sqrt(((points[rows] - points[centre]) ** 2).sum(axis=1))
        return 2 * np.arcsin(np.minimum(chord / 2, 1))

    waiting = [(-1, 0, np.arange(len(vectors)))]
    while waiting:
        parent, centre, rows = waiting.pop()
        away = angles(centre, rows)
        widest = float(away.max())
        at = len(nodes)
        if len(rows) <= leaf_rows or widest == 0:
            # many copies of one point make several leaves
            for begin in range(0, len(rows), leaf_rows):
                nodes.append(Node(parent, widest, centre, rows[begin : begin + leaf_rows]))
            continue
        nodes.append(Node(parent, widest, centre))
        left, kept = rows[np.argsort(away, kind="stable")], []
        for _ in range(CENTRES):
            if len(left) <= leaf_rows:
                break
            # the next centre is the first point not covered yet
            near = angles(left[0], left) <= widest * SHRINK
            if near.sum() > leaf_rows // 4:
                waiting.append((at, int(left[0]), left[near]))
            else:
                kept.append(left[near])
            left = left[~near]
        kept = np.concatenate([*kept, left])
        for begin in range(0, len(kept), leaf_rows):
            part = kept[begin : begin + leaf_rows]
            centre = int(part[0])
            nodes.append(Node(at, float(angles(centre, part).max()), centre, part))
    return sphere, nodes


@dataclass
class Tree:
    """A tree as read back: per inner node its children's centres and angles in one array."""

    sphere: float
    centres: dict[int, np.ndarray] = field(default_factory=dict)
    angles: dict[int, np.ndarray] = field(default_factory=dict)
    children: dict[int, list[int]] = field(default_factory=dict)
    leaves: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def bounds(self, node: int, query: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that the children may hold."""
        if not self.sphere or not norm:
            nothing = np.zeros(len(self.angles[node]))
            return nothing, nothing
        most = norm * self.sphere
        angle = np.arccos(np.clip(self.centres[node] @ query / most, -1, 1))
        low = most * np.cos(np.minimum(angle + self.angles[node], math.pi))
        high = most * np.cos(np.maximum(angle - self.angles[node], 0))
        slack = 1e-6 * most + 1e-6
        return low - slack, high + slack


def read_tree(rows: list[dict], exact_floats: bool) -> Tree:
    kind = np.float64 if exact_floats else np.int64
    below: dict[int, list[dict]] = {}
    for row in rows:
        below.setdefault(row["parent"], []).append(row)
    tree = Tree(rows[0]["sphere"])
    for parent, own in below.items():
        tree.children[parent] = [r["node"] for r in own]
        tree.centres[parent] = np.array([r["centre"] for r in own], np.float64)
        tree.angles[parent] = np.array([r["angle"] for r in own])
        for r in own:
            if len(r["ids"]):
                tree.leaves[r["node"]] = r["ids"], r["vectors"].reshape(len(r["ids"]), -1).astype(kind)
    return tree


class Best:
    """The first few (score, id) of a window of scores: higher ones first, then smaller ids."""

    def __init__(self, most: int, low: int | None = None, high: int | None = None) -> None:
        self.most, self.low, self.high = most, low, high
        self.found: list[tuple[int, int]] = []

    def least(self) -> float:
        """What a node must be able to reach."""
        if len(self.found) == self.most:
            return -self.found[-1][0]
        return -math.inf if self.low is None else self.low

    def wants(self, low: float, high: float) -> bool:
        return high >= self.least() and (self.high is None or low <= self.high)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least()
        if self.high is not None:
            good &= scores <= self.high
        if good.any():
            scores, ids = scores[good], ids[good]
            order = np.lexsort((ids, -scores))[: self.most]
            new = [(-int(s), int(i)) for s, i in zip(scores[order], ids[order], strict=True)]
            self.found = sorted(self.found + new)[: self.most]


def descend(trees: list[Tree], query: np.ndarray, windows: list[Best], own: int | None) -> None:
    """Fill the windows from the trees, the node with the highest bound first."""
    real = query.astype(np.float64)
    norm = math.sqrt(float(real @ real))
    heap: list[tuple[float, float, int, int]] = []

    def open_(t: int, node: int) -> None:
        low, high = trees[t].bounds(node, real, norm)
        reach = min(w.least() for w in windows)
        for n in np.flatnonzero(high >= reach):
            heapq.heappush(heap, (-float(high[n]), float(low[n]), t, trees[t].children[node][n]))

    def verify(pending: list[tuple[int, int]]) -> None:
        held = [trees[t].leaves[node] for t, node in pending]
        ids = np.concatenate([h[0] for h in held])
        scores = np.concatenate([h[1] @ query.astype(h[1].dtype) for h in held])
        if own is not None:
            other = ids != own
            scores, ids = scores[other], ids[other]
        for w in windows:
            w.offer(scores, ids)

    for t in range(len(trees)):
        open_(t, -1)
    pending: list[tuple[int, int]] = []
    together = 1
    while heap:
        high, low, t, node = heapq.heappop(heap)
        if any(w.wants(low, -high) for w in windows):
            if node not in trees[t].leaves:
                open_(t, node)
                continue
            pending.append((t, node))
        elif all(-high < w.least() for w in windows):
            break
        if len(pending) == together:
            verify(pending)
            pending, together = [], min(2 * together, LEAVES_AT_ONCE)
    if pending:
        verify(pending)


# --- tables ------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Batches of sorted rows cut where one of the first ``keys`` columns changes."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:keys]]
        values = list(zip(*columns, strict=True))
        begin = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[begin]:
                if values[begin] != now and held:
                    yield now, held
                    held = []
                now = values[begin]
                held.append(batch.slice(begin, i - begin))
                begin = i
    if held:
        yield now, held


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), size)


def _trees(points: DataFrame, leaf_rows: int) -> DataFrame:
    """(shard, size, label, node, parent, sphere, angle, centre, ids, vectors), a row per node."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, size, label), held in _groups(batches, 3):
            rows = pa.Table.from_batches(held)
            ids, vectors = rows["id"].to_numpy(), _matrix(rows["vector"], size)
            sphere, nodes = cover_tree(vectors, leaf_rows)
            for begin in range(0, len(nodes), 256):
                part = nodes[begin : begin + 256]
                none = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard] * len(part), pa.int32()),
                        "size": pa.array([size] * len(part), pa.int32()),
                        "label": pa.array([label] * len(part), pa.int64()),
                        "node": pa.array(range(begin, begin + len(part)), pa.int64()),
                        "parent": pa.array([n.parent for n in part], pa.int64()),
                        "sphere": pa.array([sphere] * len(part), pa.float64()),
                        "angle": pa.array([n.angle for n in part], pa.float64()),
                        "centre": pa.array([vectors[n.centre] for n in part], pa.list_(pa.int64())),
                        "ids": pa.array([none if n.rows is None else ids[n.rows] for n in part], pa.list_(pa.int64())),
                        "vectors": pa.array(
                            [none if n.rows is None else vectors[n.rows].ravel() for n in part], pa.list_(pa.int64())
                        ),
                    }
                )

    dealt = points.select("shard", "size", "label", "id", "vector")
    dealt = dealt.repartitionByRange(shuffle_partitions(points.sparkSession), "shard", "size", "label")
    return dealt.sortWithinPartitions("shard", "size", "label", "id").mapInArrow(
        tidy_after(build), f"shard int, {NODE}"
    )


def _searched(trees: DataFrame, queries: DataFrame, blocks: int, shards: int, search: str, most: int) -> DataFrame:
    """Ask every shard for every query: (anchor, window, id, score), the shard's best per window.

    ``queries`` has (id, size, label, vector, lows, highs); ``search`` says whether the own
    label is searched (``same``), or all others.
    """
    empty = {"lows": "array<bigint>", "highs": "array<bigint>"}
    index = trees.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "size",
        "label", "node", "parent", "sphere", "angle", "centre", "ids", "vectors",
        *[F.lit(None).cast(t).alias(c) for c, t in empty.items()],
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.lit(1).alias("kind"),
        "size",
        "label",
        F.col("id").alias("node"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("parent", "bigint"), ("sphere", "double"), ("angle", "double"))],
        F.col("vector").alias("centre"),
        *[F.lit(None).cast("array<bigint>").alias(c) for c in ("ids", "vectors")],
        *empty,
    )
    group = ["shard", "block"]
    work = index.union(asked).repartitionByRange(shuffle_partitions(trees.sparkSession), *group)
    work = work.sortWithinPartitions(*group, "kind", "size", "label", "node")

    def forest(held: list[pa.RecordBatch]) -> dict[tuple[int, int], Tree]:
        rows: dict[tuple[int, int], list[dict]] = {}
        for batch in held:
            lists = {c: batch[c] for c in ("centre", "ids", "vectors")}
            plain = {c: batch[c].to_pylist() for c in ("size", "label", "node", "parent", "sphere", "angle")}
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in plain.items()}
                row |= {c: v[i].values.to_numpy(zero_copy_only=False) for c, v in lists.items()}
                rows.setdefault((row["size"], row["label"]), []).append(row)
        exact = all(r[0]["sphere"] < 2.0**26 for r in rows.values())
        return {key: read_tree(own, exact) for key, own in rows.items()}

    def answer(trees_: dict[tuple[int, int], Tree], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        keys = zip(*[batch[c].to_pylist() for c in ("size", "label", "node")], strict=True)
        lows, highs = batch["lows"].to_pylist(), batch["highs"].to_pylist()
        for i, (size, label, anchor) in enumerate(keys):
            query = batch["centre"][i].values.to_numpy(zero_copy_only=False)
            _fits(np.array([float((query.astype(np.float64) ** 2).sum())]))
            if search == "same":
                among = [t for key, t in trees_.items() if key == (size, label)]
                windows = [Best(most)]
            else:
                among = [t for key, t in trees_.items() if key[0] == size and key[1] != label]
                windows = [Best(most, low, high) for low, high in zip(lows[i], highs[i], strict=True)]
            descend(among, query, windows, anchor if search == "same" else None)
            out += [(anchor, w, id_, -s) for w, window in enumerate(windows) for s, id_ in window.found]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
            names=["anchor", "window", "id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_: dict[tuple[int, int], Tree] = {}
        shard = None
        for (number, block, kind), held in _groups(batches, 3):
            if kind == 0:
                trees_, shard = forest(held), (number, block)
                continue
            if shard != (number, block):
                trees_ = {}
            for batch in held:
                yield from answer(trees_, batch)

    found = work.mapInArrow(tidy_after(run), "anchor bigint, window int, id bigint, score bigint")
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), scores are their integer inner products; higher
    ones come first, ties by smaller id. The positives of an anchor (a row where ``anchor``
    holds) are the first other rows of its label. Its negatives for a positive are the first
    rows of other labels with lowest * positive_score <= 100 * score <= highest *
    positive_score; ``rank`` counts them from 1. Pairs without a negative give no row.

    Rows with a null id, label or vector, or a null or non-finite component take no part.
    Vectors of different lengths have no inner product and do not meet; empty ones have 0.
    An id is one vector: of rows that repeat it the smallest by label and components
    counts. Scores beyond 64 bits are an error. An empty table gives an empty table; other
    columns are not looked at. Every candidate is in the trees, whatever their number.
    """
    vector, spark = col(vector_col), rows.sparkSession
    proper = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != math.inf))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double")).cast("bigint"))
    taking = rows.where(col(id_col).isNotNull() & col(label_col).isNotNull() & vector.isNotNull() & proper)
    entry = F.struct(col(label_col).cast("bigint").alias("label"), whole.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    points = taking.select(col(id_col).cast("bigint").alias("id"), entry.alias("entry"))
    points = points.groupBy("id").agg(F.min("entry").alias("entry")).select("id", "entry.*")
    points = written(points.withColumn("size", F.size("vector")), "negatives-points")
    # three numbers
    n, anchors = points.agg(F.count("*"), F.count_if("anchor")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-anchors // block_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    trees = written(_trees(dealt, leaf_rows), "negatives-trees")

    none = F.lit(None).cast("array<bigint>")
    asking = points.where("anchor")
    first = asking.select("id", "size", "label", "vector", none.alias("lows"), none.alias("highs"))
    found = written(_searched(trees, first, blocks, shards, "same", positives), "negatives-positives")
    found = found.select(
        F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("window", "positive_score"))), lambda w: w["positive_score"])
    scores = found.groupBy("anchor_id").agg(ordered.alias("scores"))
    second = asking.join(scores, asking["id"] == scores["anchor_id"]).select(
        "id", "size", "label", "vector",
        # whole numbers, so that windows are exact: rounded up below and down above
        F.transform("scores", lambda s: -_percent(-s, lowest)).alias("lows"),
        F.transform("scores", lambda s: _percent(s, highest)).alias("highs"),
    )
    below = _searched(trees, second, blocks, shards, "other", negatives)
    return below.join(
        found, (F.col("anchor") == F.col("anchor_id")) & (below["window"] == found["window"])
    ).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _percent(value: Column, percent: int) -> Column:
    """So many hundredths of a whole number, rounded down; in decimals, since products may not fit."""
    product = value.cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)")
    return F.floor(product / F.lit(100).cast("decimal(3,0)")).cast("bigint")
