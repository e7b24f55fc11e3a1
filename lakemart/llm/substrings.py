"""Removing repeated passages of words, with merged count-min sketches in front.

Counting every window of 20 words exactly would move the corpus several times. So a
first pass estimates counts (:mod:`lakemart.llm.sketches`): each partition of documents
makes a count-min sketch of all its windows, the sketches of all partitions are added up
block by block, and a partition gets back which of its cells count two or more. The
estimate of a window is the least of its cells. Collisions can only raise it, so no
repeated window is lost.

The second pass looks up the windows of the documents in those cells and takes only the
ones estimated repeated. They go to shards by their anchors (:mod:`lakemart.llm.anchors`)
and are grouped there exactly (by a 64-bit hash of the anchor's words and another of all
words). Each task keeps the earliest place of a window and settles all later ones
itself, so that a passage in a third of all documents reaches its shard once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm import anchors, sketches
from lakemart.llm.anchors import RUN_TYPE, Units, dealt, gathered, runs_of
from lakemart.llm.common import by_value, col, fresh, shuffle_partitions, tidy_after

by_value(__name__)

WINDOW_WORDS = 20
ANCHOR_WORDS = 8
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SPACE = re.compile(rb"[\x20\x09-\x0d]")
BYTES_AT_ONCE = 1 << 20

# Occurrences beyond which the windows of an anchor are dealt one by one.
CROWD = 1_000_000

_RUN = {"anchor": np.uint64, "key": np.int64, "id": np.int64, "start": np.int32, "count": np.int32}
_WINDOW = ("anchor", "words", "key", "id", "start", "state")


def slices(data: bytes) -> Iterator[bytes]:
    """Parts of about a megabyte that end before white space."""
    at = 0
    while at < len(data):
        space = SPACE.search(data, at + BYTES_AT_ONCE)
        to = space.start() if space else len(data)
        yield data[at:to]
        at = to


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of every word, as uint64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    parts = [
        np.array([xxhash.xxh64_intdigest(w) for w in part.split()], np.uint64) for part in slices(data)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def repeated_windows(
    spread: DataFrame, names: dict[str, str], text_col: str, kind: Units, crowd: int
) -> DataFrame:
    """Packed runs of windows whose words also start earlier.

    Earlier is a smaller id, or the same document and an earlier start; documents with
    the same id and different texts are put in an order by their keys. ``spread`` holds
    the documents dealt by key.
    """
    shards = shuffle_partitions(spread.sparkSession)
    answers = sketches.answers(spread, names, text_col, kind, crowd)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = dict(zip(_WINDOW, map(np.concatenate, zip(*held, strict=True)), strict=True))
        columns, later = earliest_first(columns)
        known = anchors.consecutive(*[columns[c][later] for c in ("key", "id", "start")])
        known = {"anchor": known["key"].view(np.uint64), **known}
        shard = anchors.shard_of(known["anchor"], shards)
        yield from dealt(shard, True, known, [b""] * len(shard))
        open_ = {name: c[~later] for name, c in columns.items()}
        # windows of an anchor of which nothing is known go both ways, and meet all others
        for chosen, alone in ((open_["state"] != sketches.CROWD, False), (open_["state"] != sketches.CLEAR, True)):
            runs, words = packed_runs({name: c[chosen] for name, c in open_.items()}, alone)
            first = np.frombuffer(b"".join([w[:8] for w in words]), np.uint64)
            yield from dealt(anchors.shard_of(first if alone else runs["anchor"], shards), False, runs, words)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        known: dict[int, sketches.Estimates] = {}
        for batch in batches:
            keys, ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            parts = batch.column(4).to_numpy()
            for i in np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)).tolist():
                known[int(parts[i])] = sketches.Estimates(batch.column(3)[i].as_py(), shards)
            rows = ((i, word_hashes(t.as_py())) for i, t in enumerate(texts))
            for group in anchors.pieces(rows, kind.window):
                w = anchors.windows(group, kind)
                words = sketches.window_hashes(w, kind)
                hit, state = sketches.estimated(w, words, parts, known)
                row = w.row[hit]
                held.append((w.hash[hit], words[hit], keys[row], ids[row], w.start[hit].astype(np.int32), state))
                size += len(row)
                if size > anchors.HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, runs = gathered(batches, _RUN | {"content": np.uint64})
        which, j = anchors.spread_out(runs["count"])
        columns = {name: runs[name][which] for name in ("anchor", "key", "id")}
        columns |= {"words": runs["content"], "start": (runs["start"][which] + j).astype(np.int32)}
        columns, later = earliest_first(columns)
        found = anchors.consecutive(*[columns[c][later] for c in ("key", "id", "start")])
        found = {name: np.concatenate([known[name], c]) for name, c in found.items()}
        yield from anchors.apart(found["key"], found, shards)

    kinds = anchors.packed_type([*_RUN, "content"])
    docs = sketches.with_answers(spread, names, text_col, answers)
    sent = docs.mapInArrow(tidy_after(collect), kinds)
    return sent.repartitionById(shards, F.col("shard")).mapInArrow(tidy_after(settle), RUN_TYPE)


def packed_runs(columns: dict[str, np.ndarray], alone: bool) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """Consecutive windows with one anchor as a run, and the hashes of its windows.

    With ``alone`` every window is a run of its own.
    """
    order = np.lexsort((columns["start"], columns["id"], columns["key"]))
    c = {name: x[order] for name, x in columns.items()}
    new = np.ones(len(order), bool)
    if not alone:
        new[1:] = c["start"][1:] != c["start"][:-1] + 1
        for name in ("anchor", "key", "id"):
            new[1:] |= c[name][1:] != c[name][:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(new)])
    data = c["words"].tobytes()
    words = [data[8 * a : 8 * (a + n)] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    runs = {name: c[name][first] for name in ("anchor", "key", "id", "start")}
    return runs | {"count": count.astype(np.int32)}, words


def earliest_first(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Windows sorted by their words, then place; and which have an earlier equal one.

    Entries of repeated rows are one document, so the same place twice counts once.
    """
    order = np.lexsort([columns[c] for c in ("start", "key", "id", "words", "anchor")])
    columns = {name: c[order] for name, c in columns.items()}
    run = runs_of(columns["anchor"], columns["words"])
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[run] if len(run) else run
    same = np.ones(len(run), bool)
    for name in ("id", "key", "start"):
        same &= columns[name] == columns[name][first]
    return columns, ~same


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
    crowd: int = CROWD,
    alias: str = "repeats",
) -> DataFrame:
    """Add a struct (n_words, n_removed, kept) of each text without repeats.

    A word goes if a window of ``window`` words over it also starts earlier: in a
    document with a smaller id, or before it in the same one. Windows are judged on the
    input. ``kept`` is the text with the removed words cut out together with the white
    space behind them; a text that loses nothing stays as it is. Texts may have any
    length; a long one is cut into slices whose windows overlap.

    A null text has no words and stays null. A null id counts as smaller than all
    others. Rows with the same id and text are one document: they get the same result,
    and don't make each other's words repeats. Rows with the same id and different
    texts come in the order of a hash of the row's id and text. Texts shorter than a window lose
    nothing. An empty table gives an empty table. All columns stay; one that is named
    like ``alias`` is replaced.
    """
    if window < ANCHOR_WORDS:
        raise ValueError(f"a window has {ANCHOR_WORDS} words at least")
    kind = Units(word_hashes, window, ANCHOR_WORDS)
    wide, names = anchors.keyed(docs, id_col, text_col)
    names |= {part: fresh(wide, part) for part in ("part", "found")}
    spread = wide.repartition(names["key"])
    runs = repeated_windows(spread, names, text_col, kind, crowd)
    fields = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
    marks = anchors.settled_runs(runs)
    return anchors.removal(spread, names, text_col, marks, window, cut_words, fields, alias)


def cut_words(text: str | None, runs: np.ndarray) -> tuple[int, int, str | None]:
    """(words, removed words, kept text) given runs of words to cut."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not len(runs):
        return sum(len(part.split()) for part in slices(data)), 0, text
    kept, gone, count, run, begun = [], 0, 0, 0, 0
    for found in WORD.finditer(data):
        while run < len(runs) and count >= runs[run, 1]:
            run += 1
        if run < len(runs) and count >= runs[run, 0]:
            if count == runs[run, 0]:
                kept.append(data[begun : found.start()])
            gone += 1
            begun = None
        elif begun is None:
            begun = found.start()
        count += 1
    if begun is not None:
        kept.append(data[begun:])
    return count, gone, b"".join(kept).decode("utf-8", "surrogatepass")
