"""Near-duplicate vectors by small-world graphs, one per shard.

Vectors are compared within a label. Equal vectors are one node from the start, so
copies cost nothing. The nodes of a label are cut into shards of bounded size; over
each a hierarchical navigable small-world graph is built, and every node of the label
queries every shard. A search keeps a beam of the best nodes met. How wide it must be is
measured in each shard: a sample of queries is answered by comparing with all its nodes,
and beams are widened until the graph finds enough of those answers. A query whose whole
beam is near enough may have more such neighbours, so its beam is widened until it has
an end, up to comparing with everything. Pairs found are verified in double precision.

A task works on many queries at a time. Of the pairs it sends on what connects them (a
star per component), and to count links the pairs of searches whose beam had an end, at
most a beam's width each: either side may have found a pair, and it counts for both. A
widened search sends its number of links only, so crowds don't make all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, col, shuffle_partitions, tidy_after, written
from lakemart.llm.components import connected_components, stars

by_value(__name__)

NEAR = 0.98
SHARD_ROWS = 100_000
QUERY_ROWS = 1_000_000
LINKS = 12
BUILD_BEAM = 40
FIRST_BEAM = 32
EXPANDED = 3
AUDITED = 100
# Nodes sampled at most to find that many with a partner, and queries audited of each lot.
SAMPLED = 2_000
AUDITED_OF_LOT = 16
RECALL = 0.99
INSERTED_AT_ONCE = 512
QUERIED_AT_ONCE = 256
# A widened beam costs about as much as comparing with so many nodes per place of it.
COMPARED_PER_PLACE = 64
COMPARED_AT_ONCE = 4_000_000
# Room for the error of single precision in the graph; pairs are verified afterwards.
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; scaled first, so nothing overflows."""
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def diverse(to_node: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Choose links: (rows, candidates) marks of those nearer to the node than to any chosen one.

    Candidates come best first with -inf for none. Were the nearest ones chosen alone, a
    crowd of near-duplicates would link to itself only.
    """
    rows, width = to_node.shape
    chosen = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -np.inf)
    count = np.zeros(rows, int)
    for j in range(width):
        ok = (to_node[:, j] > closest[:, j]) & (count < most)
        chosen[:, j] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, j, :]), closest)
    # places left over go to the best of the others
    rest = ~chosen & np.isfinite(to_node)
    room = most - count
    fill = rest & (np.cumsum(rest, axis=1) <= room[:, None])
    return chosen | fill


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, in single precision."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, seed: int = 0) -> None:
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(links)), 6).astype(int)
        self.order = rng.permutation(n)
        self.entry = -1
        self.top = -1
        self.width = [2 * links] + [links] * int(level.max(initial=0))
        self.links = [np.full((n, w), -1, np.int32) for w in self.width]
        self.most = links
        at, size = 0, 1
        while at < n:
            self._insert(self.order[at : at + size], level)
            at += size
            size = min(max(at, 32), INSERTED_AT_ONCE)

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        entry = np.full(len(new), self.entry)
        for layer in range(max(self.top, int(level[new].max())), -1, -1):
            joins = level[new] >= layer
            if layer <= self.top:
                near, sims = self._search(self.x[new], entry, BUILD_BEAM if joins.any() else 1, layer)
                entry = np.where(near[:, 0] >= 0, near[:, 0], entry)
            else:
                near, sims = np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf, np.float32)
            if joins.any():
                self._connect(new[joins], near[joins], sims[joins], layer)
        best = int(new[np.argmax(level[new])])
        if level[best] > self.top:
            self.entry, self.top = best, int(level[best])

    def _connect(self, new: np.ndarray, near: np.ndarray, sims: np.ndarray, layer: int) -> None:
        among = self.x[new] @ self.x[new].T
        np.fill_diagonal(among, -np.inf)
        if len(new) > 1:
            width = min(len(new) - 1, self.most)
            inner = np.argpartition(-among, width - 1, axis=1)[:, :width]
            near = np.concatenate([near, new[inner]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among, inner, axis=1)], axis=1)
        self._choose(new, near, sims, layer, self.most)
        # the links back
        to = self.links[layer][new]
        u, v = np.repeat(new, to.shape[1]), to.ravel()
        u, v = u[v >= 0], v[v >= 0]
        back = np.einsum("ij,ij->i", self.x[u], self.x[v])
        order = np.lexsort((-back, v))
        u, v, back = u[order], v[order], back[order]
        first = np.r_[True, v[1:] != v[:-1]]
        place = np.arange(len(v)) - np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
        fits = place < 2 * self.most
        u, v, back, place = u[fits], v[fits], back[fits], place[fits]
        nodes, row = np.unique(v, return_inverse=True)
        added = np.full((len(nodes), 2 * self.most), -1)
        added_sims = np.full(added.shape, -np.inf, np.float32)
        added[row, place], added_sims[row, place] = u, back
        old = self.links[layer][nodes]
        old_sims = np.einsum("ij,ikj->ik", self.x[nodes], self.x[old])
        old_sims[old < 0] = -np.inf
        near, sims = np.concatenate([old, added], axis=1), np.concatenate([old_sims, added_sims], axis=1)
        self._choose(nodes, near, sims, layer, self.width[layer])

    def _choose(self, nodes: np.ndarray, near: np.ndarray, sims: np.ndarray, layer: int, most: int) -> None:
        """Set the links of nodes from candidates; the same one twice counts once."""
        keep = min(near.shape[1], 3 * self.most + BUILD_BEAM // 2)
        for begin in range(0, len(nodes), INSERTED_AT_ONCE):
            at = slice(begin, begin + INSERTED_AT_ONCE)
            by_node = np.argsort(near[at], axis=1, kind="stable")
            sorted_near = np.take_along_axis(near[at], by_node, axis=1)
            twice = np.zeros(sorted_near.shape, bool)
            twice[:, 1:] = sorted_near[:, 1:] == sorted_near[:, :-1]
            s = np.take_along_axis(sims[at], by_node, axis=1)
            s = np.where(twice | (sorted_near < 0) | (sorted_near == nodes[at, None]), -np.inf, s)
            best = np.argsort(-s, axis=1, kind="stable")[:, :keep]
            s, c = np.take_along_axis(s, best, axis=1), np.take_along_axis(sorted_near, best, axis=1)
            x = self.x[c]
            chosen = diverse(s, x @ x.transpose(0, 2, 1), most)
            order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
            found = np.where(np.take_along_axis(chosen, order, axis=1), np.take_along_axis(c, order, axis=1), -1)
            self.links[layer][nodes[at]] = -1
            self.links[layer][nodes[at], : found.shape[1]] = found

    def _search(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes met from an entry on, for many queries: (nodes, similarities), best first."""
        out = [
            self._search_some(q[a : a + QUERIED_AT_ONCE], entry[a : a + QUERIED_AT_ONCE], beam, layer)
            for a in range(0, len(q), QUERIED_AT_ONCE)
        ]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _search_some(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        links, rows = self.links[layer], np.arange(len(q))
        nodes = np.full((len(q), beam), -1)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        met = np.zeros((len(q), len(self.x) + 1), bool)
        met[:, -1] = True  # the place of missing links
        nodes[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", q, self.x[entry]), False
        met[rows, entry] = True
        live = rows
        expanded = min(EXPANDED, beam)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = np.argsort(-open_, axis=1, kind="stable")[:, :expanded]
            ok = np.isfinite(np.take_along_axis(open_, pick, axis=1))
            going = ok[:, 0]
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            here = np.take_along_axis(nodes[live], pick, axis=1)
            picked_done = done[live]
            np.put_along_axis(picked_done, pick, True, axis=1)
            done[live] = picked_done
            near = np.where(ok[:, :, None], links[here], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[met[live[:, None], near]] = -1
            met[live[:, None], near] = True
            s = np.matmul(self.x[near], q[live][:, :, None])[:, :, 0]
            s[near < 0] = -np.inf
            all_nodes = np.concatenate([nodes[live], near], axis=1)
            all_sims = np.concatenate([sims[live], s], axis=1)
            all_done = np.concatenate([done[live], near < 0], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            nodes[live] = np.take_along_axis(all_nodes, best, axis=1)
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            done[live] = np.take_along_axis(all_done, best, axis=1)
        return nodes, sims

    def near(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(q), self.entry)
        for layer in range(self.top, 0, -1):
            nodes, _ = self._search(q, entry, 1, layer)
            entry = np.where(nodes[:, 0] >= 0, nodes[:, 0], entry)
        return self._search(q, entry, beam, 0)


class Shard:
    """A graph with the beam that its audit asked for."""

    def __init__(self, vectors: np.ndarray, near: float = NEAR) -> None:
        self.x = unit(vectors)
        self.near = near
        self.graph = Graph(self.x)
        self.beam = FIRST_BEAM
        order = np.random.default_rng(1).permutation(len(self.x))
        audited = 0
        # until enough nodes with a partner are among the sample: the others say nothing
        for at in range(0, min(len(order), SAMPLED), AUDITED):
            audited += self.audit(self.x[order[at : at + AUDITED]], order[at : at + AUDITED])
            if audited >= AUDITED:
                break

    def audit(self, q: np.ndarray, own: np.ndarray | None = None) -> int:
        """Widen the beam until queries get their true neighbours; the number of them that have any.

        The recall of each query counts alike, so a crowd does not hide what single pairs
        lose. ``own`` are the queries' nodes if they are in the graph: what a node says
        about itself does not count.
        """
        true = q @ self.x.T >= self.near
        if own is not None:
            true[np.arange(len(q)), own] = False
        some = true.any(axis=1)
        q, true = q[some], true[some]
        while len(q) and self.beam < len(self.x):
            i, j, _ = self._found(q, self.beam)
            got = np.zeros(true.shape, bool)
            got[i, j] = True
            if ((got & true).sum(axis=1) / true.sum(axis=1)).mean() >= RECALL:
                break
            self.beam *= 2
        return len(q)

    def _all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs near enough from comparing queries with all nodes."""
        rows = max(1, COMPARED_AT_ONCE // len(self.x))
        parts = [np.nonzero(q[a : a + rows] @ self.x.T >= self.near) for a in range(0, len(q), rows)]
        i = np.concatenate([part[0] + n * rows for n, part in enumerate(parts)])
        return i, np.concatenate([part[1] for part in parts])

    def _found(self, q: np.ndarray, beam: int, widened: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, node) near enough, verified in double precision, and which queries' beams had an end."""
        if beam >= len(self.x) or widened and beam * COMPARED_PER_PLACE >= len(self.x):
            return *self._all(q), np.zeros(len(q), bool)
        nodes, sims = self.graph.near(q.astype(np.float32), beam)
        hit = (sims >= self.near - SLACK) & (nodes >= 0)
        # a beam without an end may have left some out
        full = hit.all(axis=1)
        i, slot = np.nonzero(hit & ~full[:, None])
        j = nodes[i, slot]
        ok = np.einsum("ij,ij->i", q[i], self.x[j]) >= self.near
        i, j = i[ok], j[ok]
        if full.any():
            more = np.flatnonzero(full)
            a, b, _ = self._found(q[more], 4 * beam, True)
            i, j = np.concatenate([i, more[a]]), np.concatenate([j, b])
        return i, j, ~full

    def links_of(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(offset, queries, nodes) of pairs near enough, some queries at a time, and whose beams had an end."""
        for at in range(0, len(vectors), QUERIED_AT_ONCE):
            q = unit(vectors[at : at + QUERIED_AT_ONCE])
            # queries come from other shards, too: some of each lot are audited as they are
            self.audit(q[:: max(1, len(q) // AUDITED_OF_LOT)])
            yield at, *self._found(q, self.beam)


def comparable(vector: Column, label: Column) -> Column:
    """Whether a vector can have a cosine: a label, and finite components that aren't all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


FOUND = ("node", "other", "links", "back", "shard", "own")


def _links(work: DataFrame, near: float) -> DataFrame:
    """What the searches found, in rows of three kinds, with columns :data:`FOUND`.

    A pair found by a search with an end: ``other`` is in ``shard`` and has ``links``
    copies, ``node`` is in ``own`` and has ``back`` copies. The number of ``links`` that a
    widened search found in ``shard``, without other. Pairs that connect, without links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node, **values) -> pa.RecordBatch:
            columns = {"node": node, **values}
            arrays = [pa.array(columns.get(c, [None] * len(node)), pa.int64()) for c in FOUND]
            return pa.RecordBatch.from_arrays(arrays, names=list(FOUND))

        def answer(place, shard, nodes, copies, q_nodes, q_copies, q_own, q_vectors) -> Iterator[pa.RecordBatch]:
            for at, i, j, ended in shard.links_of(q_vectors):
                lot = slice(at, at + QUERIED_AT_ONCE)
                here, here_copies, here_own = q_nodes[lot], q_copies[lot], q_own[lot]
                other = here[i] != nodes[j]
                i, j = i[other], j[other]
                a, b = i[ended[i]], j[ended[i]]
                pairs = {"other": nodes[b], "links": copies[b], "back": here_copies[a], "own": here_own[a]}
                yield out(here[a], **pairs, shard=np.full(len(a), place))
                a, b = i[~ended[i]], j[~ended[i]]
                links = np.bincount(a, copies[b].astype(float), len(here)).astype(np.int64)
                some = links > 0
                yield out(here[some], links=links[some], shard=np.full(int(some.sum()), place))
                u, v = stars(here[i], nodes[j])
                yield out(u, other=v)

        group, shard = None, None
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True))
            begin = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[begin]:
                    continue
                *own, is_query = keys[begin]
                part = batch.slice(begin, end - begin)
                node, copies, home = (part.column(c).to_numpy() for c in (5, 6, 7))
                vectors = part.column(8).flatten().to_numpy().reshape(end - begin, -1)
                begin = end
                if own != group:
                    group, shard, held = own, None, []
                if not is_query:
                    held.append((node, copies, vectors))
                    continue
                if shard is None and held:
                    nodes, counts, x = map(np.concatenate, zip(*held, strict=True))
                    shard, held = Shard(x, near), []
                if shard is not None:
                    yield from answer(own[2], shard, nodes, counts, node, copies, home, vectors)

    return work.mapInArrow(tidy_after(run), ", ".join(f"{c} bigint" for c in FOUND))


def _link_counts(found: DataFrame) -> DataFrame:
    """(node, links): a pair counts once for each of its nodes, whichever found it.

    What a widened search counted in a shard holds for that shard; pairs that nodes of
    the shard found would count twice there and are left out.
    """
    counted = found.where("other is null").select("node", "shard", "other", "links")
    pairs = found.where("other is not null and links is not null")
    there = pairs.select("node", "shard", "other", "links")
    back = pairs.select(
        F.col("other").alias("node"), F.col("own").alias("shard"), F.col("node").alias("other"), F.col("back").alias("links")
    )
    once = counted.union(there).union(back).groupBy("node", "shard", "other").agg(F.max("links").alias("links"))
    of_shard = once.groupBy("node", "shard").agg(
        F.max(F.when(F.col("other").isNull(), F.col("links"))).alias("counted"), F.sum("links").alias("links")
    )
    return of_shard.groupBy("node").agg(F.sum(F.coalesce("counted", "links")).alias("links"))


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    near: float = NEAR,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows``; other columns are left out.

    Vectors with equal labels link if their cosine is ``near`` or more. ``n_links``
    counts the other rows linked to, ``component_id`` is the smallest id that can be
    reached over links, and the row that has it is kept.

    Rows with a null label, and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; so do vectors of different lengths with
    each other. Repeated rows are copies and link with each other. A row with a null id
    counts for the others and is no candidate for component_id; that is null, and the
    row kept, if its component has no id. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    vector, label = col(vector_col), col(label_col)
    named = rows.select(
        col(id_col).alias("vec_id"),
        F.when(comparable(vector, label), label.cast("string")).alias("label"),
        F.when(comparable(vector, label), vector.cast("array<double>")).alias("vector"),
    )
    named = named.withColumns({"one": F.xxhash64("vector"), "two": F.xxhash64(F.lit(1), "vector")})
    same = ["label", "one", "two"]
    distinct = (
        named.where("label is not null")
        .groupBy(*same)
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("size", F.size("vector"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # node numbers must stay as they are
    distinct = written(distinct, "vectors")
    # as long as there are labels and lengths
    sizes = distinct.groupBy("label", "size").agg(F.count("*").alias("n"))
    sized = distinct.join(sizes, ["label", "size"]).withColumns(
        {"shards": F.ceil(F.col("n") / shard_rows), "blocks": F.ceil(F.col("n") / query_rows)}
    )
    own_shard = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    own_block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    last = ["node", "copies", own_shard.alias("own"), "vector"]
    index = sized.select(
        "label", "size", own_shard.alias("shard"), every("blocks").alias("block"), F.lit(0).alias("query"), *last
    )
    queries = sized.select(
        "label", "size", every("shards").alias("shard"), own_block.alias("block"), F.lit(1).alias("query"), *last
    )
    group = ["label", "size", "shard", "block"]
    work = index.union(queries).repartitionByRange(shuffle_partitions(spark), *group)
    found = written(_links(work.sortWithinPartitions(*group, "query"), near), "vector-links")
    links = _link_counts(found)
    edges = found.where("other is not null and links is null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    roots = connected_components(edges, "vector-components")
    placed = distinct.select(*same, "node", "first", "copies").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(least, "root").select(
        *same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = F.col("label").isNull()
    joined = named.drop("vector").join(placed, same, "left")
    return joined.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
