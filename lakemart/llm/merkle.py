"""A Merkle tree over a table: leaves per row, a subtree per group, one root; proofs and their check.

Leaves are numbered per group and cut into aligned blocks of a power of two. A block keeps
each of its levels as one string, the hex digests of its nodes one behind the other: the
parents are the digests of its substrings of two nodes' width, and the sibling of a node is
the substring that flanks it. The roots of a group's blocks are the leaves of the next round,
blocks of blocks, until one is left; the groups' subroots go the same way to the root. A round
shortens the table a thousandfold, so a row's path is put together from a few joins of tables
with a row per block. All of it is SQL functions; no block holds more than its thousand rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import col, written
from lakemart.llm.numbering import joined, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_BITS = 10
# A digest in hex.
WIDTH = 64

PATH = "array<struct<sibling:string,left:boolean>>"

# The digests of all pairs of a level, the last node alone if their number is odd.
PARENTS = f"""cast(array_join(transform(
    sequence(0, cast(ceil(octet_length(level) / {2 * WIDTH}) as int) - 1),
    i -> sha2(substring(level, i * {2 * WIDTH} + 1, {2 * WIDTH}), 256)), '') as binary)"""

# Per level below a block's root the node beside the row's, empty where there is none.
SIBLINGS = f"""transform(levels, (level, j) -> named_struct(
    'sibling', cast(substring(level, (shiftright(x.pos, j) ^ 1) * {WIDTH} + 1, {WIDTH}) as string),
    'left', shiftright(x.pos, j) % 2 = 1))"""

# The digest of a node between its siblings, level by level.
FOLDED = """aggregate(path, start, (node, s) ->
    sha2(concat(if(s.left, s.sibling, ''), node, if(s.left, '', s.sibling)), 256))"""


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as byte count, colon and text, or a dash for null."""

    def spelled(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[spelled(v) for v in values]), 256)


def _grown(nodes: DataFrame, groups: list[str], label: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of (groups, number, digest, item) rows, and what lies above each of them.

    The first has (groups, block, items, levels, root), the second (groups, block, path,
    top): the siblings from a block's root up to the group's root, and that root.
    """
    by = [col(c) for c in groups]
    entry = F.struct(F.expr(f"cast(number & {(1 << bits) - 1} as int)").alias("pos"), "digest", "item")
    gathered = nodes.groupBy(*by, F.shiftright("number", bits).alias("block")).agg(
        F.sort_array(F.collect_list(entry)).alias("items")
    )
    if groups:
        sized = joined(gathered, nodes.groupBy(*by).agg(F.count("*").alias("n")), groups)
    else:
        sized = gathered.withColumn("n", F.lit(nodes.count()))
    # as many levels as the group needs, all of a block's if it has several blocks
    height = F.expr(f"if(n <= 1, 0, least(length(bin(n - 1)), {bits}))")
    bottom = F.array_join(F.transform("items", lambda x: x["digest"]), "").cast("binary")
    grow = f"""aggregate(if(height = 0, cast(array() as array<int>), sequence(1, height)), array(bottom),
        (levels, j) -> concat(levels, transform(slice(levels, -1, 1), level -> {PARENTS})))"""
    blocks = sized.select(*by, "block", "items", height.alias("height"), bottom.alias("bottom"))
    blocks = blocks.select(*by, "block", "items", F.expr(grow).alias("levels"))
    blocks = blocks.select(
        *by,
        "block",
        "items",
        F.expr("slice(levels, 1, size(levels) - 1)").alias("levels"),
        F.element_at("levels", -1).cast("string").alias("root"),
    )
    blocks = written(blocks, label)
    # one number: whether there is a further round
    most = blocks.agg(F.max("block")).first()[0]
    if not most:
        nothing = F.array().cast(PATH).alias("path")
        return blocks, blocks.select(*by, "block", nothing, F.col("root").alias("top"))
    upper = blocks.select(
        *by, F.col("block").alias("number"), F.col("root").alias("digest"), F.struct("block").alias("item")
    )
    above = _unfolded(*_grown(upper, groups, label, bits), groups)
    return blocks, above.select(*by, "item.block", "path", "top")


def _unfolded(blocks: DataFrame, above: DataFrame, groups: list[str]) -> DataFrame:
    """The items of blocks with their siblings up to the top, and what else ``above`` has."""
    whole = joined(blocks, above.withColumnRenamed("path", "upper"), [*groups, "block"])
    others = [c for c in whole.columns if c not in ("block", "items", "levels", "root", "upper")]
    placed = F.expr(f"transform(items, x -> named_struct('item', x.item, 'digest', x.digest, 'own', {SIBLINGS}))")
    rows = whole.select(*[col(c) for c in others], "upper", F.inline(placed))
    return rows.select(
        *[col(c) for c in others], "item", "digest", F.concat("own", "upper").alias("path")
    )


def prove(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    claims: Mapping[str, Column] | None = None,
    when: Column | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified), one row per row of ``docs``.

    ``leaf`` is the digest of the row's ``fields``. Leaves ascend by id within their group,
    groups by their value; nulls come first, ids that are equal go by their leaf. ``path``
    has the sibling at each level, empty where a node is hashed alone, and whether it stands
    left. ``folded_root`` is computed from the path and the leaf of what is claimed to be in
    the table: ``claims`` gives other values of fields for the rows where ``when`` holds.
    ``verified`` tells whether that is the root.

    Nulls in any column are values like any other, and so is a null group. Repeated rows
    are leaves of their own with proofs of their own. Texts may have any length. A single
    leaf is its own subroot, a single subroot the root. An empty table gives an empty
    table. Other columns are not looked at.
    """
    claimed = dict(claims or {})
    wrong = F.lit(False) if when is None else F.coalesce(when, F.lit(False))
    leaves = docs.select(
        col(id_col).alias("doc_id"),
        col(group_col).alias("group"),
        leaf([col(c) for c in fields]).alias("digest"),
        F.when(wrong, leaf([claimed.get(c, col(c)) for c in fields])).alias("claim"),
    )
    numbers = numbered(leaves, ["group"], ["doc_id", "digest"], "merkle-leaves")
    nodes = numbers.select("group", "number", "digest", F.struct("doc_id", "claim").alias("item"))
    blocks, above = _grown(nodes, ["group"], "merkle-blocks", block_bits)
    subroots = above.groupBy("group").agg(F.min("top").alias("digest"))
    ordered = numbered(subroots, [], ["group"], "merkle-subroots")
    tops = ordered.select("number", "digest", F.struct("group").alias("item"))
    groups = _unfolded(*_grown(tops, [], "merkle-top", block_bits), [])
    groups = groups.select(
        "item.group", F.col("path").alias("group_path"), F.col("top").alias("root")
    )
    above = joined(above, groups, ["group"]).select(
        "group", "block", F.concat("path", "group_path").alias("path"), F.col("top").alias("subroot"),
        F.col("root").alias("whole"),
    )
    rows = _unfolded(blocks, above, ["group"]).select(
        "item.doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.col("whole").alias("root"),
        "path",
        F.coalesce("item.claim", "digest").alias("start"),
    )
    folded = rows.withColumn("folded_root", F.expr(FOLDED)).drop("start")
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
