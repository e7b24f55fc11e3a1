"""SimHash near-duplicates found by a self-join of binary tries.

A text becomes 64 bits: each bit says whether it is set in over half of the XXH64
values of the text's word shingles. Equal fingerprints are one node of the join, so
copies cost nothing there.

Two fingerprints within 3 bits agree on at least one of four 16-bit blocks. Each
fingerprint is therefore entered in four tries, one per block, with that block turned
to the top; in trie i only subtrees under one and the same top block are joined. The
subtrees are spread over the cluster by (trie, top block). A block with more than
``hot`` fingerprints is cut once more in the same way: of the other 48 bits at least
one of four 12-bit parts agrees too, so its fingerprints are spread over 4 x 4096
subtrees. Nothing is left out.

Within a subtree pairs of nodes are traversed together, all pairs of one level at a
time: a pair's children differ in the bits of the parents plus the last step, and a
pair that differs in more bits than allowed is dropped with everything below it. What
leaves a task is not every pair but a star per component that the task has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, col, fresh, shuffle_partitions, tidy, tidy_after, written
from lakemart.llm.components import connected_components, stars

by_value(__name__)

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BLOCK = 16
HOT_BLOCK = 4096
# What a task holds at once: shingle hashes, fingerprints, and node pairs of a level.
HASHES_AT_ONCE = 65_536
KEYS_AT_ONCE = 100_000
PAIRS_AT_ONCE = 100_000
FOUND_AT_ONCE = 400_000


def fingerprint_of(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64 bits of one text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), HASHES_AT_ONCE):
        part = slice(i, i + HASHES_AT_ONCE)
        digest = b"".join(
            [xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(first[part], last[part], strict=True)]
        )
        bits = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes())


def fingerprint(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """64-bit SimHash of a text column as a bigint; null and empty texts have zero."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint_of(t.as_py(), width) for t in texts], dtype=np.uint64)
        tidy()
        return pa.array(found.view(np.int64))

    return run(text)


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


class _Pairs:
    """Pairs found so far; when there are many, what connects them takes their place."""

    def __init__(self, contract: bool) -> None:
        self.contract = contract
        self.a, self.b = [], []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.size += len(a)
        if self.contract and self.size > FOUND_AT_ONCE:
            a, b = stars(np.concatenate(self.a), np.concatenate(self.b))
            # a star has fewer edges than keys, so this leaves room again
            self.a, self.b, self.size = [a], [b], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(self.a), np.concatenate(self.b)


def close_pairs(
    keys: np.ndarray, group: np.ndarray, top: int, most: int, contract: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``keys`` (uint64, sorted within each ``group``) at ``most`` bits or less.

    Keys of a group agree in their ``top`` highest bits, which is where the traversal
    starts. Nodes are ranges of the sorted keys. With ``contract``, pairs that connect
    the same keys may stand for those found.
    """
    keys = keys.astype(np.uint64)
    n = len(keys)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    lo, hi = edge, np.r_[edge[1:], n][: len(edge)]
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    found = _Pairs(contract)
    # node pairs (a, b) by level: range of a, range of b, bits in which they differ
    open_ = [(top, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while open_:
        level, alo, ahi, blo, bhi, bits = open_.pop()
        if len(alo) == 0:
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():  # two paths without branches: settle all further bits at once
            a, b = alo[single], blo[single]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= most
            found.add(a[near], b[near])
            rest = ~single
            alo, ahi, blo, bhi, bits = alo[rest], ahi[rest], blo[rest], bhi[rest], bits[rest]
        if level == 64 or len(alo) == 0:
            continue
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            for part in (slice(half, None), slice(None, half)):
                open_.append((level, alo[part], ahi[part], blo[part], bhi[part], bits[part]))
            continue
        if level not in zeros:
            unset = (keys >> np.uint64(63 - level)) & np.uint64(1) == 0
            zeros[level] = np.concatenate([[0], np.cumsum(unset)])
        z = zeros[level]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        self_ = alo == blo
        other = ~self_
        parts = [
            (alo, amid, blo, bmid, bits),
            (amid, ahi, bmid, bhi, bits),
            (alo, amid, bmid, bhi, bits + 1),
            (amid[other], ahi[other], blo[other], bmid[other], bits[other] + 1),
        ]
        alo, ahi, blo, bhi, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ahi > alo) & (bhi > blo) & (bits <= most) & ~((alo == blo) & (ahi - alo == 1))
        open_.append((level + 1, alo[keep], ahi[keep], blo[keep], bhi[keep], bits[keep]))
    return found.all()


def _turned(bits: Column, by: int) -> Column:
    """Turn 64 bits to the left."""
    if by == 0:
        return bits
    return F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))


def _tries(prints: DataFrame, hot: int) -> DataFrame:
    """(trie, top, key, print): each fingerprint in the tries and subtrees that it is joined in.

    ``key`` is the fingerprint turned so that the bits shared in a subtree come first.
    """
    blocks = prints.select(
        "print",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("trie"), _turned(F.col("print"), BLOCK * i).alias("key"))
                    for i in range(64 // BLOCK)
                ]
            )
        ).alias("t"),
    ).select("print", "t.trie", "t.key", F.shiftrightunsigned("t.key", 64 - BLOCK).alias("top"))
    crowded = blocks.groupBy("trie", "top").count().where(F.col("count") > hot)
    marked = blocks.join(
        crowded.select("trie", "top", F.lit(True).alias("is_hot")), ["trie", "top"], "left"
    )
    plain = marked.where("is_hot is null").select("trie", "top", "key", "print")
    # the 48 lower bits, turned by 12 at a time below the shared top block
    low = F.col("key").bitwiseAND(F.lit((1 << 48) - 1))
    parts = []
    for j in range(4):
        by = 12 * j
        turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, 48 - by)) if by else low
        key = F.shiftleft(F.col("top"), 48).bitwiseOR(turned.bitwiseAND(F.lit((1 << 48) - 1)))
        parts.append(F.struct(F.lit(4 + j).alias("part"), key.alias("key")))
    cut = marked.where("is_hot").select("trie", "print", F.explode(F.array(*parts)).alias("t"))
    deep = cut.select(
        (F.col("trie") * 8 + F.col("t.part")).alias("trie"),
        F.shiftrightunsigned("t.key", 64 - BLOCK - 12).alias("top"),
        "t.key",
        "print",
    )
    return plain.union(deep)


def linked(prints: DataFrame, most: int = MAX_BITS, hot: int = HOT_BLOCK) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints as links of ``most`` bits do.

    ``prints`` has one bigint column ``print`` without repeats and nulls. Four blocks
    leave room for at most 3 bits.
    """
    if not 0 <= most < 64 // BLOCK:
        raise ValueError("at most 3 bits may differ")
    spark = prints.sparkSession

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
            trie, top, key, value = columns
            group = np.cumsum(np.r_[True, (trie[1:] != trie[:-1]) | (top[1:] != top[:-1])])
            # the order of signed keys within a group is that of unsigned ones: same top bits
            a, b = close_pairs(key.view(np.uint64), group, BLOCK, most, contract=True)
            u, v = stars(value[a], value[b])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list[np.ndarray] = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(held[0]) > KEYS_AT_ONCE:
                # the last subtree may go on in the next batch
                same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                cut = int(np.argmax(same))
                if cut:
                    yield solve([c[:cut] for c in held])
                    held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield solve(held)

    tries = _tries(prints, hot).repartition(shuffle_partitions(spark), "trie", "top")
    ordered = tries.sortWithinPartitions("trie", "top", "key")
    return ordered.mapInArrow(tidy_after(join), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    most: int = MAX_BITS,
    hot: int = HOT_BLOCK,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``, other columns are left out.

    Texts link when their fingerprints differ in ``most`` bits or less; component_id is
    the smallest id that can be reached over links. Null and empty texts, and texts of
    white space, have fingerprint zero and link like any other. A row with a null id
    takes part in links, and is no candidate for component_id: that is null if its
    component has no other id. Repeated rows come out as often as they come in. An
    empty table gives an empty table.
    """
    rows = _printed(docs, id_col, text_col, width)
    placed = _placed(rows, most, hot)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("print", "root").join(least, "root").select("print", "component_id")
    return rows.join(named, "print").select(
        "doc_id", as_hex(F.col("print")).alias("fingerprint"), "component_id"
    )


def _printed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    rows = docs.select(col(id_col).alias("doc_id"), fingerprint(col(text_col), width).alias("print"))
    return written(rows, "simhash")


def _placed(rows: DataFrame, most: int, hot: int) -> DataFrame:
    """(print, first, root) of each fingerprint: its smallest id and its component."""
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    edges = linked(prints.select("print"), most, hot)
    roots = connected_components(edges, "simhash-components", stars_already=True)
    return prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    most: int = MAX_BITS,
    hot: int = HOT_BLOCK,
) -> DataFrame:
    """One document of each group: the row with the group's smallest id.

    A row is told by its id and fingerprint, so an id that occurs in several groups leads
    those where it is the smallest, each with its own text. Of rows that have both in
    common the one with the smallest text stays; of repeated rows one stays. A group
    without any id keeps a row with its smallest fingerprint, and of these the smallest
    text. Texts may have any length, null ones are empty. An empty table gives an empty
    table. All columns stay as they are.
    """
    rows = _printed(docs, id_col, text_col, width)
    leader = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "print")).alias("leader")
    leaders = _placed(rows, most, hot).groupBy("root").agg(leader).select(
        F.col("leader.first").alias("doc_id"), "leader.print"
    )
    leaders = written(leaders, "simhash-leaders")
    # ids with several fingerprints; all others are told by themselves
    several = rows.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b"))
    several = written(several.where("doc_id is not null and a != b").select("doc_id"), "simhash-several")
    id_, print_ = fresh(docs, "id"), fresh(docs, "print")
    shared = several.withColumnRenamed("doc_id", id_)
    clear = leaders.where("doc_id is not null").join(several, "doc_id", "left_anti")
    lead = docs.join(clear.select(F.col("doc_id").alias(id_)), col(id_col) == F.col(id_), "left_semi")
    unclear = leaders.join(several, "doc_id", "left_semi").union(leaders.where("doc_id is null"))
    unclear = unclear.select(F.col("doc_id").alias(id_), F.col("print").alias(print_))
    rest = docs.join(shared, col(id_col) == F.col(id_), "left_semi").union(docs.where(col(id_col).isNull()))
    told = fresh(docs, "told")
    rest = rest.withColumn(told, fingerprint(col(text_col), width))
    rest = rest.join(unclear, col(id_col).eqNullSafe(F.col(id_)) & (F.col(told) == F.col(print_)), "left_semi")
    return _one_per(lead, [id_col], text_col).unionByName(_one_per(rest, [id_col, told], text_col).drop(told))


def _one_per(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per key, the one with the smallest text, by a minimum that sums up early."""
    row = fresh(docs, "row")
    plain = [c for c in docs.columns]
    packed = docs.groupBy(*[col(k) for k in keys]).agg(
        F.min(F.struct(col(text_col).alias("t"), F.struct(*[col(c) for c in plain]).alias("r"))).alias(row)
    )
    return packed.select(f"{row}.r.*")
