"""Removing byte strings that also start in an earlier document, by suffix sorting.

A 50-byte string of one document can only also be in another one if its anchor is
(:mod:`lakemart.llm.anchors`), so what gets sorted are the stretches around anchors
that several documents share. Such a stretch (consecutive strings with one anchor, up
to 84 bytes) goes to the shard of its anchor, where all equal strings meet. Each task
sends a stretch once, for the smallest document that it has seen it in, and settles
the others itself. An anchor with more than ``crowd`` occurrences would gather too many
different stretches in one shard: its strings are sent one by one instead, each to the
shard of its own hash.

A shard lays its different stretches side by side and orders their suffixes in two
stages. Suffixes smaller than their successors are sorted directly. All others follow
from them in one scan over the buckets of first bytes: a suffix larger than its
successor takes the next place in its bucket when the scan meets the successor. The
scan handles a bucket at a time as arrays. Common prefixes of neighbours in that order
then show which strings are equal. Only the order of the first 50 bytes is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm import anchors
from lakemart.llm.anchors import RUN_TYPE, Units, dealt, gathered, runs_of
from lakemart.llm.common import by_value, shuffle_partitions, tidy_after

by_value(__name__)

WINDOW_BYTES = 50
ANCHOR_BYTES = 16
# Occurrences beyond which an anchor's strings are dealt one by one. The list of such
# anchors travels to all tasks: at most 8 bytes for each million anchors, or 20 MB of text.
CROWD = 1_000_000
STRETCHES_HELD = 100_000
BYTES_SORTED = 1 << 20

_BYTE_VALUES = anchors.mix(np.arange(1, 257, dtype=np.uint64))
_STRING_BASE = np.uint64(0xD6E8FEB86659FD93)

# count: strings in the stretch
_STRETCH = {"hash": np.uint64, "key": np.int64, "id": np.int64, "start": np.int32, "count": np.int32}


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def byte_values(units: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[units]


def repeated_across(hashes: np.ndarray, keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Entries whose hash is found in several documents."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.lexsort((keys, hashes))
    run = runs_of(hashes[order])
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.r_[starts[1:], len(run)] - 1
    sorted_keys = keys[order]
    several = (sorted_keys[starts] != sorted_keys[ends]) | (np.maximum.reduceat(more[order], starts) > 0)
    out = np.empty(len(hashes), bool)
    out[order] = several[run]
    return out


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; zeros follow the end."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for have in (1, 2, 4):
        x = (x[:-have] << np.uint64(8 * have)) | x[have:]
    return x[: len(text)]


def rises(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor; the empty one is smallest."""
    n = len(text)
    ends = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]
    rising = np.r_[text[ends[:-1]] < text[ends[:-1] + 1], False]
    return np.repeat(rising, np.diff(np.r_[-1, ends]))


def sorted_directly(places: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their next ``depth`` bytes, eight bytes at a time."""
    order = places[np.argsort(eight[places], kind="stable")]
    group = runs_of(eight[order])
    for at in range(8, depth, 8):
        size = np.bincount(group, minlength=group[-1] + 1 if len(group) else 0)
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        value = eight[np.minimum(order[tied] + at, len(eight) - 1)]
        again = np.lexsort((value, group[tied]))
        order[tied] = order[tied][again]
        fine = np.zeros(len(order), np.uint64)
        fine[tied] = value[again]
        group = runs_of(group, fine)
    return order


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places of ``text`` in the order of their suffixes' first ``depth`` bytes.

    ``text`` is followed by zeros for at least ``depth`` bytes, which are not wanted.
    """
    n = len(text)
    small = rises(text)
    # a suffix that is not sorted directly needs its successors up to one that is
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    places = np.flatnonzero(wanted)
    step = np.zeros(n + 2, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, np.minimum(next_small[places], n - 1) + 1, -1)
    needed = np.cumsum(step)[:n] > 0
    direct = sorted_directly(np.flatnonzero(needed & small), eights(text), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    induced = needed & ~small
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        pending[text[n - 1]].append(np.array([n - 1]))
    found = []
    for byte in range(256):
        head = pending[byte]
        front = np.concatenate(head) if head else np.zeros(0, np.int64)
        whole = [front]
        while len(front):  # runs of one byte stay in the bucket
            before = front[front > 0] - 1
            front = before[induced[before] & (text[before] == byte)]
            whole.append(front)
        bucket = np.concatenate([*whole, direct[cuts[byte] : cuts[byte + 1]]])
        if not len(bucket):
            continue
        found.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > byte)]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            for value, at in anchors.by_key(first):
                pending[value].append(before[at])
    order = np.concatenate(found) if found else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(order: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place has in common with the one before it in the order, up to ``depth``."""
    a, b = order[:-1], order[1:]
    length = np.zeros(len(order), np.int64)
    equal = np.ones(len(a), bool)
    for at in range(0, depth, 8):
        differ = eight[a + at] ^ eight[b + at]
        leading = sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8))
        length[1:] += np.where(equal, leading, 0)
        equal &= differ == 0
    return np.minimum(length, depth)


def first_owner(contents: list[bytes], owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest owner of each string, offsets): strings are ``contents[i][j:j + window]``.

    The strings of content i are at ``offsets[i]`` and on.
    """
    length = np.array([len(c) for c in contents])
    text = np.frombuffer(b"".join(contents) + bytes(window + 8), np.uint8)
    begin = np.cumsum(length) - length
    count = length - window + 1
    offsets = np.cumsum(count) - count
    which = np.repeat(np.arange(len(contents)), count)
    places = begin[which] + np.arange(len(which)) - offsets[which]
    wanted = np.zeros(len(text), bool)
    wanted[places] = True
    order = suffix_order(text, wanted, window)
    new = common_prefixes(order, eights(text), window) < window
    new[0] = True
    run = np.cumsum(new) - 1
    number = np.empty(len(text), np.int64)
    number[places] = np.arange(len(places))
    string = number[order]
    least = np.minimum.reduceat(owner[which[string]], np.flatnonzero(new))
    out = np.empty(len(places), np.int64)
    out[string] = least[run]
    return out, offsets


def repeated_strings(
    docs: DataFrame, spread: DataFrame, names: dict[str, str], text_col: str, kind: Units, crowd: int
) -> DataFrame:
    """Packed runs of strings that also start in a document with a smaller id."""
    shards = shuffle_partitions(docs.sparkSession)
    window = kind.window
    places, hot = anchors.repeated_anchors(
        docs, names["key"], text_col, kind, True, repeated_across, crowd
    )

    def flush(held: list[tuple[np.ndarray, ...]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Keep stretches of the smallest id that has them, settle those of other documents."""
        columns = dict(zip(_STRETCH, map(np.concatenate, zip(*held, strict=True)), strict=True))
        seen: dict[bytes, int] = {}
        same = np.array([seen.setdefault(t, len(seen)) for t in texts])
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, same, columns["id"])
        later = columns["id"] > least[same]
        known = {name: c[later] for name, c in columns.items()}
        shard = anchors.shard_of(known["key"].view(np.uint64), shards)
        yield from dealt(shard, True, known, [b""] * len(shard))
        asked = {name: c[~later] for name, c in columns.items()}
        kept = [texts[i] for i in np.flatnonzero(~later)]
        yield from dealt(anchors.shard_of(asked["hash"], shards), False, asked, kept)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            whole, found = batch.column(2), batch.column(3)
            rows = ((i, utf8(t.as_py())) for i, t in enumerate(whole))
            for group in anchors.pieces(rows, window):
                w = anchors.windows(group, kind)
                hit = anchors.candidate_windows(w, found)
                if not len(hit):
                    continue
                at, row, start, anchor, hash_ = w.at[hit], w.row[hit], w.start[hit], w.anchor[hit], w.hash[hit]
                crowded = np.isin(hash_, hot)
                new = np.ones(len(hit), bool)
                new[1:] = crowded[1:] | crowded[:-1] | (start[1:] != start[:-1] + 1)
                new[1:] |= (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                if crowded.any():
                    own = anchors.rolled(w.values, window, _STRING_BASE)[at[crowded]]
                    hash_[crowded] = anchors.mix(own)
                first = np.flatnonzero(new)
                count = np.diff(np.r_[first, len(hit)])
                data, ends = w.units.tobytes(), at[first] + count + window - 1
                texts += [data[a:b] for a, b in zip(at[first].tolist(), ends.tolist(), strict=True)]
                row = row[first]
                held.append(
                    (hash_[first], keys[row], ids[row], start[first].astype(np.int32), count.astype(np.int32))
                )
                if len(texts) > STRETCHES_HELD:
                    yield from flush(held, texts)
                    held, texts = [], []
        if held:
            yield from flush(held, texts)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = gathered(batches, _STRETCH | {"content": np.uint8})
        parts = [[known[c] for c in ("key", "id", "start", "count")]]
        size = open_["count"] + (window - 1)
        end = np.cumsum(size, dtype=np.int64)
        order = np.argsort(open_["hash"], kind="stable")
        data = open_["content"].tobytes()
        for block in _blocks(open_["hash"][order], size[order]):
            at = order[block]
            here = {name: open_[name][at] for name in _STRETCH}
            spans = zip((end - size)[at].tolist(), end[at].tolist(), strict=True)
            seen: dict[bytes, int] = {}
            content = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in spans])
            owner = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(owner, content, here["id"])
            least, offsets = first_owner(list(seen), owner, window)
            which, j = anchors.spread_out(here["count"])
            later = here["id"][which] > least[offsets[content[which]] + j]
            which, j = which[later], j[later]
            runs = anchors.consecutive(here["key"][which], here["id"][which], here["start"][which] + j)
            parts.append(list(runs.values()))
        names_ = ("key", "id", "start", "count")
        found = {n: np.concatenate(c) for n, c in zip(names_, zip(*parts, strict=True), strict=True)}
        yield from anchors.apart(found["key"], found, shards)

    kinds = anchors.packed_type([*_STRETCH, "content"])
    sent = anchors.candidates(spread, names, text_col, places).mapInArrow(tidy_after(collect), kinds)
    return sent.repartitionById(shards, F.col("shard")).mapInArrow(tidy_after(settle), RUN_TYPE)


def _blocks(hashes: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Cut a shard between hashes into blocks of about :data:`BYTES_SORTED`."""
    if not len(hashes):
        return
    total = np.cumsum(sizes, dtype=np.int64)
    cuts = np.flatnonzero(np.r_[hashes[1:] != hashes[:-1], True]) + 1
    begin, done = 0, 0
    for cut in cuts.tolist():
        if total[cut - 1] - done > BYTES_SORTED or cut == len(hashes):
            yield slice(begin, cut)
            begin, done = cut, int(total[cut - 1])


def remove_shared(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_BYTES,
    crowd: int = CROWD,
    alias: str = "shared",
) -> DataFrame:
    """Add a struct (n_bytes, n_removed, n_spans, kept) of each text.

    A byte goes if a string of ``window`` bytes over it also starts in a document with
    a smaller id. Strings are judged on the input; they never cross documents. ``kept``
    is what remains, as bytes, since a cut may fall inside a character. Texts may have any
    length; only stretches around bytes that documents share meet in a task.

    A null text has no bytes. A null id counts as smaller than all others. Rows with
    the same id don't take from each other, whatever their texts; repeated rows get the
    same result. Texts shorter than ``window`` lose nothing. An empty table gives an
    empty table. All columns stay; one that is named like ``alias`` is replaced.
    """
    if window < ANCHOR_BYTES:
        raise ValueError(f"a string has {ANCHOR_BYTES} bytes at least")
    kind = Units(utf8, window, ANCHOR_BYTES, byte_values)
    wide, names = anchors.keyed(docs, id_col, text_col)
    spread = wide.repartition(names["key"])
    runs = repeated_strings(wide, spread, names, text_col, kind, crowd)

    fields = {name: pa.int64() for name in ("n_bytes", "n_removed", "n_spans")} | {"kept": pa.binary()}
    marks = anchors.settled_runs(runs)
    return anchors.removal(spread, names, text_col, marks, window, cut_bytes, fields, alias)


def cut_bytes(text: str | None, runs: np.ndarray) -> tuple[int, int, int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    edges = [0, *runs.ravel().tolist(), len(data)]
    kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return len(data), len(data) - len(kept), len(runs), kept
