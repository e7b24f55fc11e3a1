"""Finding stretches that several places of a corpus share, without moving the corpus.

A window is a run of ``window`` consecutive units (words or bytes) of one document.
Each window has an anchor: of the shorter grams of ``gram`` units in it, the leftmost
one with the smallest hash. The anchor depends on the window's units alone, so equal
windows have equal anchors at the same place within them, and neighbouring windows
mostly share theirs: anchors are some ten times fewer than windows. What holds for an
anchor bounds what holds for its windows: a window can't occur more often than its
anchor.

The way from documents to repeated anchors and back:

1. each task finds the anchors of its documents; those that it sees repeatedly itself
   are known to be repeated, and of each of them one entry represents all;
2. entries go to a shard by hash, which decides which anchors are repeated;
3. their places go back to the documents, keyed by a 64-bit document key. Two
   documents with one key would only make more candidates;
4. runs of consecutive windows with one anchor go to the shard of the anchor, where
   equal windows meet and are compared exactly. An anchor with more than ``crowd``
   occurrences would gather too much in one shard, so its windows are dealt one by one;
5. what a shard decides goes back to the documents in the same way.

A hash that a third of all documents share so reaches its shard once per task and
:data:`HELD` entries. Entries travel packed, a row for each sender and receiver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, col, fresh, shuffle_partitions, tidy, tidy_after, written

by_value(__name__)

# Units worked on at once, and entries a task holds before it passes them on.
UNITS_AT_ONCE = 1 << 18
HELD = 1 << 19
ROWS_AT_ONCE = 500
_PLACE_BITS = np.uint64(20)
_PLACE = np.uint64((1 << 20) - 1)

# The finalizer of 64-bit MurmurHash3.
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Stands for a null id, before all others.
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_1
    x ^= x >> np.uint64(33)
    x *= _MIX_2
    x ^= x >> np.uint64(33)
    return x


def rolled(units: np.ndarray, width: int, base: np.uint64 = _GRAM_BASE) -> np.ndarray:
    """A polynomial hash of every run of ``width`` units, put together by doubling."""
    power, have, step = units, 1, base
    out, done, out_step = None, 0, np.uint64(1)
    while True:
        if width & have:
            if out is None:
                out, done = power, have
            else:
                n = len(units) - done - have + 1
                out = out[:n] + out_step * power[done : done + n]
                done += have
            with np.errstate(over="ignore"):
                out_step = out_step * step
        if 2 * have > width:
            return out
        n = len(power) - have
        power = power[:n] + step * power[have:]
        have *= 2
        with np.errstate(over="ignore"):
            step = step * step


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


@dataclass(frozen=True)
class Units:
    """What windows are made of.

    ``read`` gives a text's units as an array of integers, ``values`` turns units into
    well mixed uint64 values (when they aren't already).
    """

    read: Callable[[str | None], np.ndarray]
    window: int
    gram: int
    values: Callable[[np.ndarray], np.ndarray] | None = None


@dataclass
class Piece:
    """Consecutive units of one document; ``row`` is its place in the batch."""

    row: int
    base: int
    units: np.ndarray


def pieces(rows: Iterator[tuple[int, np.ndarray]], window: int) -> Iterator[list[Piece]]:
    """Deal documents into lists of about :data:`UNITS_AT_ONCE` units.

    Long documents are cut into pieces that overlap by a window less one unit, so each
    window lies in exactly one piece. Documents shorter than a window have none.
    """
    held: list[Piece] = []
    size = 0
    for row, units in rows:
        for base in range(0, len(units) - window + 1, UNITS_AT_ONCE):
            part = units[base : base + UNITS_AT_ONCE + window - 1]
            if size and size + len(part) > UNITS_AT_ONCE + window - 1:
                yield held
                held, size = [], 0
            held.append(Piece(row, base, part))
            size += len(part)
    if held:
        yield held


@dataclass
class Windows:
    """All windows of some pieces: per window the place among the units, the batch row,
    the start within the document, the anchor's start there, and the anchor's hash."""

    units: np.ndarray
    values: np.ndarray
    at: np.ndarray
    row: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def windows(group: list[Piece], kind: Units) -> Windows:
    window, gram = kind.window, kind.gram
    units = np.concatenate([p.units for p in group])
    values = kind.values(units) if kind.values else units
    lengths = np.array([len(p.units) for p in group])
    ends = np.cumsum(lengths)
    grams = mix(rolled(values, gram))
    placed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(placed, window - gram + 1) & _PLACE).astype(np.int64)
    end = np.repeat(ends, lengths)[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + window <= end)
    piece = np.repeat(np.arange(len(group)), lengths)[at]
    shift = np.array([p.base for p in group])[piece] - (ends - lengths)[piece]
    anchor = anchor[at]
    row = np.array([p.row for p in group])[piece]
    return Windows(units, values, at, row, at + shift, anchor + shift, grams[anchor])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Anchors have small hashes, so they are mixed again."""
    return (mix(hashes ^ _GRAM_BASE) % np.uint64(shards)).astype(np.int64)


def by_key(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of every run of equal keys."""
    if len(keys):
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
            yield int(keys[a]), slice(a, b)


def dealt(
    shards: np.ndarray, known: bool, columns: dict[str, np.ndarray], texts: list[bytes] | None = None
) -> Iterator[pa.RecordBatch]:
    """One row per shard: its entries, a packed value per column; ``texts`` are joined."""
    pack = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(shards, kind="stable")
    shards = shards[order]
    columns = {name: c[order] for name, c in columns.items()}
    runs = list(by_key(shards))
    if runs:
        arrays = [pa.array([s for s, _ in runs], pa.int32()), pa.array([known] * len(runs))]
        arrays += [pa.array([pack(c[at].tobytes()) for _, at in runs], pa.binary()) for c in columns.values()]
        names = ["shard", "known", *columns]
        if texts is not None:
            joined = [pack(b"".join([texts[i] for i in order[at]])) for _, at in runs]
            arrays, names = [*arrays, pa.array(joined, pa.binary())], [*names, "content"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def gathered(
    batches: Iterator[pa.RecordBatch], dtypes: dict[str, type]
) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """All entries of a shard's rows by column: (known ones, open ones).

    What shards receive grows with the corpus over ``spark.sql.shuffle.partitions``.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    found: dict[bool, dict[str, list[bytes]]] = {k: {name: [] for name in dtypes} for k in (True, False)}
    for batch in batches:
        for known, *values in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
            for name, value in zip(dtypes, values, strict=True):
                found[known][name].append(unpack(value))

    def joined(parts: dict[str, list[bytes]]) -> dict[str, np.ndarray]:
        return {name: np.frombuffer(b"".join(parts[name]), dtype) for name, dtype in dtypes.items()}

    return joined(found[True]), joined(found[False])


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal values each place of sorted columns belongs to."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def apart(keys: np.ndarray, columns: dict[str, np.ndarray], shards: int, known: bool = True):
    """Deal entries by their document key."""
    yield from dealt(shard_of(keys.view(np.uint64), shards), known, columns)


Decide = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

_ANCHOR = {"hash": np.uint64, "key": np.int64, "place": np.int32, "more": np.uint32}
_PLACE_OF = {"key": np.int64, "place": np.int32}
_RUN = {"key": np.int64, "id": np.int64, "start": np.int32, "count": np.int32}


def packed_type(dtypes: dict[str, type]) -> str:
    return "shard int, known boolean, " + ", ".join(f"{name} binary" for name in dtypes)


def _flushed(hash_: np.ndarray, key: np.ndarray, place: np.ndarray, across: bool, shards: int):
    """Send a task's anchors: settle those that repeat here, ask the shard about the rest."""
    order = np.lexsort((key, hash_))
    sorted_hash, sorted_key = hash_[order], key[order]
    run = runs_of(sorted_hash)
    first = np.r_[True, run[1:] != run[:-1]]
    starts = np.flatnonzero(first)
    size = np.diff(np.r_[starts, len(run)])
    if across:
        repeated = sorted_key[starts] != sorted_key[starts + size - 1]
    else:
        repeated = size > 1
    # back in the order of documents, which packs best
    here, ask, more = np.empty(len(run), bool), np.empty(len(run), bool), np.empty(len(run), np.uint32)
    here[order] = repeated[run]
    ask[order] = ~repeated[run] | first
    more[order] = np.where(repeated, size, 0)[run]
    columns = {"hash": hash_, "key": key, "place": place, "more": more}
    settled = {name: c[here] for name, c in columns.items()}
    yield from apart(settled["key"], settled, shards)
    asked = {name: c[ask] for name, c in columns.items()}
    yield from dealt(shard_of(asked["hash"], shards), False, asked)


def repeated_anchors(
    docs: DataFrame,
    key: str,
    text: str,
    kind: Units,
    across: bool,
    decide: Decide,
    crowd: int,
) -> tuple[DataFrame, np.ndarray]:
    """Where anchors are that ``decide`` calls repeated, and the hashes of crowded ones.

    ``across`` asks for repeats in different documents. ``decide`` gets a shard's entries
    (hash, document key, how many occurrences the entry stands for if not for one) and
    marks the repeated ones. The frame has a row (key, places) per document with such
    anchors; ``places`` packs 32-bit starts. The hashes are those with more than
    ``crowd`` occurrences: at most one in ``crowd`` anchors, so they may reach the driver.
    """
    shards = shuffle_partitions(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1)
            rows = ((i, kind.read(t.as_py())) for i, t in enumerate(texts))
            for group in pieces(rows, kind.window):
                w = windows(group, kind)
                new = np.r_[True, (w.row[1:] != w.row[:-1]) | (w.anchor[1:] != w.anchor[:-1])]
                held.append((w.hash[new], keys[w.row[new]], w.anchor[new].astype(np.int32)))
                size += int(new.sum())
                if size > HELD:
                    yield from _flushed(*map(np.concatenate, zip(*held, strict=True)), across, shards)
                    held, size = [], 0
        if held:
            yield from _flushed(*map(np.concatenate, zip(*held, strict=True)), across, shards)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = gathered(batches, _ANCHOR)
        hit = decide(open_["hash"], open_["key"], open_["more"])
        hot = np.zeros(0, np.uint64)
        if len(hit):
            hashes, at = np.unique(open_["hash"], return_inverse=True)
            hot = hashes[np.bincount(at, weights=np.maximum(open_["more"], 1)) > crowd]
        # an entry that stands for several is only there to be counted
        hit &= open_["more"] == 0
        keys = np.concatenate([known["key"], open_["key"][hit]])
        places = np.concatenate([known["place"], open_["place"][hit]])
        yield from apart(keys, {"key": keys, "place": places}, shards)
        if len(hot):
            yield from dealt(np.zeros(len(hot), np.int64), False, {"key": hot, "place": hot})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = gathered(batches, _PLACE_OF)
        order = np.lexsort((known["place"], known["key"]))
        keys, places = known["key"][order], known["place"][order]
        runs = list(by_key(keys))
        found = [places[at].tobytes() for _, at in runs]
        columns = [pa.array([k for k, _ in runs], pa.int64()), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "places"])

    by_shard = F.col("shard")
    sent = docs.select(col(key), col(text)).mapInArrow(tidy_after(find), packed_type(_ANCHOR))
    judged = sent.repartitionById(shards, by_shard).mapInArrow(tidy_after(judge), packed_type(_PLACE_OF))
    judged = written(judged, "repeated-anchors")
    unpack_hot = zstandard.ZstdDecompressor().decompress
    rows = judged.where("not known").select("key").collect()
    crowded = b"".join(unpack_hot(bytes(row["key"])) for row in rows)
    places = judged.where("known").repartitionById(shards, by_shard)
    return places.mapInArrow(tidy_after(unpack), "key bigint, places binary"), np.frombuffer(crowded, np.uint64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """Documents with a 64-bit key of id and text, and the names of the added columns.

    A null id counts as the smallest; a row's identity is its id and its text, so rows
    that repeat both are one document.
    """
    names = {part: fresh(docs, part) for part in ("key", "id", "places", "marks")}
    wide = docs.withColumn(names["id"], F.coalesce(col(id_col).cast("bigint"), F.lit(NO_ID)))
    return wide.withColumn(names["key"], F.xxhash64(names["id"], col(text_col))), names


def candidates(docs: DataFrame, names: dict[str, str], text_col: str, places: DataFrame) -> DataFrame:
    """Documents that hold a repeated anchor: key, id, text, places, then the rest.

    ``docs`` is dealt by key. All its columns are kept, so that this shuffle is the same
    as that of the final step, which Spark then runs once.
    """
    places = places.select(F.col("key").alias(names["key"]), F.col("places").alias(names["places"]))
    first = [names["key"], names["id"], text_col, names["places"]]
    rest = [c for c in docs.columns if c not in first]
    return docs.join(places, names["key"]).select(*[col(c) for c in first + rest])


def candidate_windows(w: Windows, found: pa.Array) -> np.ndarray:
    """Places among the windows whose anchors are among the repeated places of their rows."""
    hit = np.zeros(len(w.row), bool)
    for row, at in by_key(w.row):
        places = np.frombuffer(found[row].as_py(), np.int32)
        hit[at] = np.isin(w.anchor[at], places)
    return np.flatnonzero(hit)


def spread_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every j below counts[i]."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts, dtype=np.int64) - counts)[which]


def consecutive(key: np.ndarray, id_: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Windows as runs of consecutive starts within a document."""
    order = np.lexsort((start, id_, key))
    key, id_, start = key[order], id_[order], start[order].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(key)][: len(first)] - 1
    start, end = start[first].astype(np.int32), start[last]
    return {"key": key[first], "id": id_[first], "start": start, "count": (end - start + 1).astype(np.int32)}


def settled_runs(dealt_runs: DataFrame) -> DataFrame:
    """(key, marks) from packed runs of windows: one row per document key.

    ``marks`` lists (id, packed starts and counts); one entry unless two documents share
    a key. It is bounded by the document's length.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, _ = gathered(batches, _RUN)
        order = np.lexsort((runs["start"], runs["id"], runs["key"]))
        runs = {name: c[order] for name, c in runs.items()}
        pair = np.stack([runs["start"], runs["count"]], axis=1)
        documents = list(by_key(runs["key"]))
        marks = [
            [{"id": i, "runs": pair[at][own].tobytes()} for i, own in by_key(runs["id"][at])]
            for _, at in documents
        ]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("runs", pa.binary())]))
        columns = [pa.array([k for k, _ in documents], pa.int64()), pa.array(marks, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "marks"])

    shards = shuffle_partitions(dealt_runs.sparkSession)
    here = dealt_runs.repartitionById(shards, F.col("shard"))
    return here.mapInArrow(tidy_after(unpack), "key bigint, marks array<struct<id:bigint,runs:binary>>")


def covered(starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Maximal stretches (from, to) under runs of windows sorted by start."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    starts = starts.astype(np.int64)
    ends = np.maximum.accumulate(starts + counts - 1 + window)
    gap = np.flatnonzero(starts[1:] > ends[:-1])
    return np.stack([starts[np.r_[0, gap + 1]], ends[np.r_[gap, len(ends) - 1]]], axis=1)


def removal(
    docs: DataFrame,
    names: dict[str, str],
    text_col: str,
    marks: DataFrame,
    window: int,
    cut: Callable[[str | None, np.ndarray], tuple],
    fields: dict[str, pa.DataType],
    alias: str,
) -> DataFrame:
    """Join documents with their marks and add ``cut(text, stretches)`` as a struct."""
    kind = pa.struct(list(fields.items()))
    ddl = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    declared = ",".join(f"{name}:{ddl[t]}" for name, t in fields.items())

    @F.arrow_udf(f"struct<{declared}>")
    def run(ids: pa.Array, texts: pa.Array, found: pa.Array) -> pa.Array:
        parts, rows = [pa.array([], kind)], []
        for i, t, m in zip(ids, texts, found, strict=True):
            own = b"".join([x["runs"] for x in m.as_py() or () if x["id"] == i.as_py()])
            pair = np.frombuffer(own, np.int32).reshape(-1, 2)
            stretches = covered(pair[:, 0], pair[:, 1], window)
            rows.append(dict(zip(fields, cut(t.as_py(), stretches), strict=True)))
            if len(rows) == ROWS_AT_ONCE:
                parts.append(pa.array(rows, kind))
                rows = []
        whole = pa.concat_arrays([*parts, pa.array(rows, kind)])
        del parts, rows
        tidy()
        return whole

    marks = marks.select(F.col("key").alias(names["key"]), F.col("marks").alias(names["marks"]))
    joined = docs.join(marks, names["key"], "left")
    result = run(col(names["id"]), col(text_col), col(names["marks"]))
    return joined.withColumn(alias, result).drop(*names.values())


RUN_TYPE = packed_type(_RUN)
