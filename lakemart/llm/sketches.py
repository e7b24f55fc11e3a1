"""Count-min sketches of the partitions of a corpus, merged by blocks of cells.

Documents are dealt to parts by key. A task makes the sketch of its part: cells with
the number of hashes that fall into them, a row of cells for each hash function, only
those in use. A row has :data:`WINDOW_CELLS` cells for each shuffle partition, so it is
as wide as the corpus needs without being counted first. Tasks send each shard the cells
of its block; the shard adds up the sketches of all parts and sends every part back
those of its own cells whose sum is large enough. Nothing else of the merged sketch is
needed to look up the hashes of that part, so no task holds more of it than a block.

There are two rows for windows and one, narrower, for their anchors. A window's estimate
is the least of its cells; hashes that meet in a cell can only raise it. So every
repeated window is estimated repeated, whatever the width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm import anchors
from lakemart.llm.anchors import Units, Windows, by_key
from lakemart.llm.common import by_value, col, shuffle_partitions, tidy_after

by_value(__name__)

#: Cells per shard in a row of windows and in the row of anchors, powers of two.
WINDOW_CELLS = 1 << 25
ANCHOR_CELLS = 1 << 22

# Windows a task holds before it passes their cells on.
HELD = 1 << 21

WINDOW_ROWS = (0, 1)
ANCHOR_ROW = 2
#: Stands for the anchors' cells with more than ``crowd`` occurrences in what shards answer.
CROWDED = 3

_SALT = np.uint64(0xD6E8FEB86659FD93)
_SENT = "shard int, part int, leader bigint, row int, cells binary, counts binary"
_ANSWER = "part int, leader bigint, row int, shard int, cells binary"


def width(row: int) -> int:
    return WINDOW_CELLS if row in WINDOW_ROWS else ANCHOR_CELLS


def addresses(hashes: np.ndarray, row: int, shards: int) -> np.ndarray:
    """The cell of each hash in a row, over the blocks of all shards."""
    mixed = anchors.mix(hashes ^ np.uint64(int(_SALT) * (2 * row + 1) % (1 << 64)))
    block = (mixed >> np.uint64(32)) % np.uint64(shards)
    return block * np.uint64(width(row)) + (mixed & np.uint64(width(row) - 1))


def packed(cells: np.ndarray) -> bytes:
    """Ascending cells as steps, byte by byte: upper bytes are mostly zero."""
    steps = np.diff(cells.astype(np.uint32), prepend=np.uint32(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    steps = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.int64)


def partial(hashes: np.ndarray, row: int, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(shard, cells, counts) of some hashes: a part's sketch, or a share of it."""
    found, counts = np.unique(addresses(hashes, row, shards), return_counts=True)
    block = (found // np.uint64(width(row))).astype(np.int64)
    cells = found % np.uint64(width(row))
    counts = np.minimum(counts, 255).astype(np.uint8) if row in WINDOW_ROWS else counts.astype(np.uint32)
    for shard, at in by_key(block):
        yield shard, packed(cells[at]), zstandard.ZstdCompressor(level=1).compress(counts[at].tobytes())


def merged(row: int, sketches: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The sum of a block's sketches; counts stop at the largest number of their type."""
    kind = np.uint8 if row in WINDOW_ROWS else np.uint32
    total = np.zeros(width(row), kind)
    for cells, counts in sketches:
        at = unpacked(cells)
        more = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), kind)
        total[at] = np.minimum(total[at].astype(np.uint64) + more, np.iinfo(kind).max)
    return total


class Estimates:
    """Which windows of a part are estimated repeated, and which anchors crowded."""

    def __init__(self, answers: list[dict], shards: int) -> None:
        self.shards = shards
        found: dict[int, list[np.ndarray]] = {row: [] for row in (*WINDOW_ROWS, ANCHOR_ROW, CROWDED)}
        for a in answers:
            found[a["row"]].append(a["shard"] * width(a["row"]) + unpacked(a["cells"]))
        self.tables = [self._table(found[row]) for row in (*WINDOW_ROWS, ANCHOR_ROW)]
        self.crowds = np.unique(np.concatenate([np.zeros(0, np.int64), *found[CROWDED]]))

    @staticmethod
    def _table(cells: list[np.ndarray]) -> np.ndarray:
        """A table for looking up cells fast; cells that share a place only raise estimates."""
        size = 1 << max(10, int(16 * sum(map(len, cells))).bit_length())
        table = np.zeros(size, bool)
        for c in cells:
            table[c & (size - 1)] = True
        return table

    def _listed(self, hashes: np.ndarray, row: int) -> np.ndarray:
        table = self.tables[row]
        return table[(addresses(hashes, row, self.shards) & np.uint64(len(table) - 1)).astype(np.int64)]

    def repeated(self, words: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Windows whose cells, and whose anchor's, all count two or more."""
        hit = self._listed(anchor, ANCHOR_ROW)
        for row in WINDOW_ROWS:
            at = np.flatnonzero(hit)
            hit[at] = self._listed(words[at], row)
        return hit

    def crowded(self, anchor: np.ndarray) -> np.ndarray:
        """Exact in the cells: parts that share an anchor agree about it."""
        return np.isin(addresses(anchor, ANCHOR_ROW, self.shards).astype(np.int64), self.crowds)


def window_hashes(w: Windows, kind: Units) -> np.ndarray:
    """A hash of all units of each window, unlike that of its anchor."""
    return anchors.mix(anchors.rolled(w.values, kind.window, _SALT)[w.at])


def with_part(spread: DataFrame, names: dict[str, str], text_col: str) -> DataFrame:
    """Documents with the number of their part: (key, id, text, part, then the rest).

    Parts are what dealing by key makes. All columns are kept, so that the shuffle that
    ``spread`` ends with is the same wherever it is used, and is run once.
    """
    part = F.pmod(F.hash(col(names["key"])), F.lit(shuffle_partitions(spread.sparkSession)))
    first = [names["key"], names["id"], text_col]
    rest = [col(c) for c in spread.columns if c not in first]
    return spread.select(*[col(c) for c in first], part.alias(names["part"]), *rest)


def answers(spread: DataFrame, names: dict[str, str], text_col: str, kind: Units, crowd: int) -> DataFrame:
    """(key, found): what the merged sketch says of each part, beside the smallest key in it.

    ``found`` lists packed cells of the part with a sum of two or more, and the anchors'
    cells with more than ``crowd``. It is bounded by the size of the part.
    """
    shards = shuffle_partitions(spread.sparkSession)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "part", "leader", "row", "cells", "counts"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        least: dict[int, int] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for part, parts in held.items():
                words, anchor = map(np.concatenate, zip(*parts, strict=True))
                for row, hashes in ((0, words), (1, words), (ANCHOR_ROW, anchor)):
                    rows = [(s, part, None, row, c, n) for s, c, n in partial(hashes, row, shards)]
                    if rows:
                        yield batch_of(rows)
            held.clear()

        for batch in batches:
            keys, texts, parts = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            for part in np.unique(parts).tolist():
                own = int(keys[parts == part].min())
                least[part] = min(own, least.get(part, own))
            rows = ((i, kind.read(t.as_py())) for i, t in enumerate(texts))
            for group in anchors.pieces(rows, kind.window):
                w = anchors.windows(group, kind)
                words, of = window_hashes(w, kind), parts[w.row]
                new = np.r_[True, (w.row[1:] != w.row[:-1]) | (w.anchor[1:] != w.anchor[:-1])]
                for part in np.unique(of).tolist():
                    here = of == part
                    held.setdefault(part, []).append((words[here], w.hash[here & new]))
                size += len(words)
                if size > HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()
        if least:
            yield batch_of([(part % shards, part, key, None, None, None) for part, key in least.items()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], list[tuple[int, bytes, bytes]]] = {}
        names_ = ["part", "leader", "row", "shard", "cells"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def out(part, leader, row, shard, cells) -> pa.RecordBatch:
            columns = [pa.array([x], k) for x, k in zip((part, leader, row, shard, cells), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names_)

        for batch in batches:
            for shard, part, leader, row, cells, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row is None:
                    yield out(part, leader, None, None, None)
                else:
                    sent.setdefault((shard, row), []).append((part, cells, counts))
        for (shard, row), sketches in sent.items():
            total = merged(row, [s[1:] for s in sketches])
            for part, data, _ in sketches:
                cells = unpacked(data)
                count = total[cells]
                if (count > 1).any():
                    yield out(part, None, row, shard, packed(cells[count > 1]))
                if row == ANCHOR_ROW and (count > crowd).any():
                    yield out(part, None, CROWDED, shard, packed(cells[count > crowd]))

    sent = with_part(spread, names, text_col).mapInArrow(tidy_after(sketch), _SENT)
    answer = sent.repartitionById(shards, F.col("shard")).mapInArrow(tidy_after(merge), _ANSWER)
    cells = F.when(F.col("row").isNotNull(), F.struct("row", "shard", "cells"))
    return answer.groupBy("part").agg(
        F.min("leader").alias(names["key"]), F.collect_list(cells).alias(names["found"])
    ).drop("part")


def with_answers(spread: DataFrame, names: dict[str, str], text_col: str, found: DataFrame) -> DataFrame:
    """(key, id, text, found, part, then the rest), ascending by key within each task.

    The document with the smallest key of a part brings the part's answer and comes
    before the others of it. Joined by sorting and merging: sending the answers to all
    tasks would part documents from it. Where a skewed partition is split all the same,
    documents come without their answer; :func:`estimated` then holds all their windows
    for repeated, which costs time but loses nothing.
    """
    parted = with_part(spread, names, text_col)
    joined = parted.join(found.hint("merge"), names["key"], "left").sortWithinPartitions(col(names["key"]))
    first = [names["key"], names["id"], text_col, names["found"], names["part"]]
    return joined.select(*[col(c) for c in first + [c for c in spread.columns if c not in first]])


#: What is known of an anchor: it isn't crowded, it is, or there was no answer.
CLEAR, CROWD, UNKNOWN = 0, 1, 2


def estimated(
    w: Windows, words: np.ndarray, parts: np.ndarray, known: dict[int, Estimates]
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows estimated repeated, and what is known of their anchors."""
    hit = np.ones(len(w.row), bool)
    state = np.full(len(w.row), UNKNOWN, np.uint8)
    of = parts[w.row]
    for part in np.unique(of).tolist():
        if part in known:
            at = np.flatnonzero(of == part)
            hit[at] = known[part].repeated(words[at], w.hash[at])
            at = at[hit[at]]
            state[at] = np.where(known[part].crowded(w.hash[at]), CROWD, CLEAR)
    at = np.flatnonzero(hit)
    return at, state[at]
