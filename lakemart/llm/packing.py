"""Packing token sequences by linear grouping and best fit.

Documents are cut into pieces of at most one sequence; from there on only lengths
matter, and there are no more of them than a sequence has places. So the plan is made
from the histogram of lengths, which the driver can hold however many documents there
are, and it is as short as that histogram allows: its entries say that pieces number
r to r + n of a length go to sequences s and on, k in each, at some offset.

The plan follows the linear grouping scheme for bin packing:

1. lengths over ``small`` are sorted and cut into groups of equal numbers of pieces;
   every piece is rounded up to the largest of its group, which leaves few sizes;
2. sequences are configurations of those few sizes. The linear program over all
   configurations is solved by generating columns (a knapsack over the sizes finds the
   configuration that is worth most), its solution rounded down, and the few pieces
   left over packed by best fit;
3. in each configuration the actual pieces take the places of the rounded ones;
4. small pieces go by best fit, longest first, each into the sequence with the least
   room that is enough; new sequences are opened when none has room.

All of this handles equal sequences together as one class with a count.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakemart.llm.common import BYTES_AT_ONCE, by_value, col, kept_in_worker, tidy_after, written

by_value(__name__)

CAPACITY = 4096
END_ID = 1
# Rows of three numbers, 130 bytes each as sent: some 50 MB at most.
STARTS_SENT = 400_000
GROUPS = 20
# Lengths up to this are packed by best fit alone: with a third of a sequence and more, a
# configuration holds two pieces, and what is left over has small ones to fill it up.
SMALL = CAPACITY // 3
VOCABULARY = "word_bpe_49k.json"
# Words whose ids a Python worker remembers, and the longest word that is remembered.
WORDS_REMEMBERED = 150_000
LONGEST_MERGED = 200
WORD_END = "</w>"
MARK = b"\x01"
# Printable ASCII and Latin-1, tabs and line ends: here both libraries split alike.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
SPECIAL = "<|"
BORDERS = "\n\t\r"
# Characters of texts whose words are looked up together.
LETTERS_AT_ONCE = 1 << 16


# --- token ids ---------------------------------------------------------------


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


class WordTokenizer:
    """Token ids of whole texts from ids of their words.

    The vocabulary's rules treat white space as a border that leaves nothing behind, so
    a text's ids are those of its words one after the other, and frequent words need
    encoding once. Words are cut at spaces, tabs and line ends only.

    In a text of printable ASCII and Latin-1 characters the rules come down to lower
    case, the split pattern and the merges; there the merges are run by tiktoken, with a
    control character for the end of a word. Texts with other characters or the start
    of a special token, and very long words, are left to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.library: Tokenizer | None = None
        # ids by word, the present and the former generation
        self.plain: list[dict[str, bytes]] = [{}, {}]
        self.others: list[dict[str, bytes]] = [{}, {}]
        rules = json.loads(Path(path).read_text())
        pattern = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(pattern)
        letters = byte_letters()
        ranks = {}
        for token, number in rules["model"]["vocab"].items():
            last = token.endswith(WORD_END) and token != WORD_END
            stem = token.removesuffix(WORD_END) if last else token
            ranks[bytes(letters[c] for c in stem) + (MARK if last else b"")] = number
        # a token that has the mark as a letter of its own can't occur in plain texts
        self.merges = tiktoken.Encoding("words", pat_str="[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[n for token, n in ranks.items() if token.endswith(MARK)]] = True

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts, whose new words are encoded together."""
        found: list[bytes] = [b""] * len(texts)
        kinds: tuple[list[int], list[int]] = ([], [])
        for i, text in enumerate(texts):
            kinds[SPECIAL in text or not is_plain(text)].append(i)
        for both, own, plain in ((self.plain, kinds[0], True), (self.others, kinds[1], False)):
            words = []
            for i in own:
                text = texts[i].lower() if plain else texts[i]
                for border in BORDERS:
                    text = text.replace(border, " ")
                words.append(text.split(" "))
            for i, data in zip(own, self._looked_up(words, both, plain), strict=True):
                found[i] = data
        return found

    def _looked_up(self, texts: list[list[str]], both: list[dict[str, bytes]], plain: bool) -> list[bytes]:
        unknown = set().union(*texts).difference(both[0])
        if len(both[0]) + len(unknown) > WORDS_REMEMBERED:
            # a full generation stays readable until the next one is full
            both[:] = [{}, both[0]]
            unknown = set().union(*texts)
        known, before = both
        get = before.get
        new = []
        for word in unknown:
            data = get(word)
            if data is None:
                new.append(word)
            else:
                known[word] = data
        known.update(self._encoded(new, plain))
        out = [b"".join(map(known.__getitem__, words)) for words in texts]
        for word in new:
            if len(word) > LONGEST_MERGED:
                del known[word]
        return out

    def _encoded(self, words: list[str], plain: bool) -> Iterator[tuple[str, bytes]]:
        short = [w for w in words if plain and len(w) <= LONGEST_MERGED]
        yield from zip(short, self._merged(short), strict=True)
        rest = [w for w in words if not plain or len(w) > LONGEST_MERGED]
        if rest and self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        coded = self.library.encode_batch(rest, add_special_tokens=False) if rest else []
        for w, e in zip(rest, coded, strict=True):
            yield w, np.array(e.ids, "<u4").tobytes()

    def forget(self) -> None:
        """Drop the remembered words: a worker lives longer than its tasks."""
        self.plain, self.others = [{}, {}], [{}, {}]

    def _merged(self, words: list[str]) -> Iterator[bytes]:
        """Ids of many words from one run of the merges; each part of a word ends in a mark."""
        marked, parts = [], []
        for word in words:
            if word.isalpha():
                marked.append(word + "\x01")
                parts.append(1)
            else:
                cut = self.parts.findall(word)
                marked += [part + "\x01" for part in cut]
                parts.append(len(cut))
        ids = np.array(self.merges.encode_ordinary("".join(marked)), "<u4")
        data = ids.tobytes()
        part_ends = np.r_[0, 4 * (np.flatnonzero(self.ends[ids]) + 1)]
        ends = part_ends[np.cumsum([0, *parts])].tolist()
        return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as.

    Printable bytes stand for themselves, the others in order for U+0100 and on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def groups_of(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, nulls empty, in groups of some :data:`LETTERS_AT_ONCE` characters, one at least."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= LETTERS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_pieces(texts: DataFrame, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece with the columns of ``texts`` but the text: piece, start, length, ids, nth.

    ``ids`` are little-endian unsigned 32-bit, as those of operator 10. ``nth`` numbers the
    pieces of each length within a task.
    """
    others = [c for c in texts.columns if c != text_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_in_worker((VOCABULARY, vocabulary), lambda: WordTokenizer(vocabulary))
        end = np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        names = [*others, "piece", "start", "length", "ids", "nth"]

        def out(batch: pa.RecordBatch, row: list, piece: list, start: list, parts: list) -> pa.RecordBatch:
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in others]
            lengths, nth = [len(part) // 4 for part in parts], []
            for length in lengths:
                nth.append(seen[length])
                seen[length] += 1
            arrays = [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
            arrays += [pa.array(lengths, pa.int64()), pa.array(parts, pa.binary()), pa.array(nth, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            row, piece, start, parts, size, i = [], [], [], [], 0, -1
            for group in groups_of(batch.column(batch.schema.get_field_index(text_col))):
                for ids in tokenizer.all_ids(group):
                    i += 1
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        row.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        parts.append(ids[at : at + 4 * capacity])
                        size += len(parts[-1])
                        if size >= BYTES_AT_ONCE:
                            yield out(batch, row, piece, start, parts)
                            row, piece, start, parts, size = [], [], [], [], 0
            if row:
                yield out(batch, row, piece, start, parts)
        tokenizer.forget()

    schema = ", ".join(f"`{c}` {t}" for c, t in texts.drop(text_col).dtypes)
    return texts.mapInArrow(
        tidy_after(cut), f"{schema}, piece int, start bigint, length bigint, ids binary, nth bigint"
    )


# --- the plan ----------------------------------------------------------------


@dataclass
class Entry:
    """Pieces ``rank`` to ``rank + count`` of one length go to ``sequence`` and on, ``each`` per sequence."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


@dataclass
class Plan:
    capacity: int
    entries: list[Entry] = field(default_factory=list)
    sequences: int = 0
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def take(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.entries.append(Entry(length, self.used[length], count, sequence, each, offset))
        self.used[length] += count


@dataclass(order=True)
class Class:
    """Sequences ``first`` to ``first + count``, all with the same room."""

    room: int
    first: int
    count: int


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count) pairs, longest first, into groups of equal numbers of pieces."""
    total = sum(n for _, n in lengths)
    quota = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = quota
    for length, n in lengths:
        while n:
            if room == 0:
                out.append([])
                room = quota
            part = min(n, room)
            out[-1].append((length, part))
            n -= part
            room -= part
    return [g for g in out if g]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """How often to use which configuration of the sizes: the linear program's optimum.

    Columns are generated from homogeneous ones on. The program's dual prices come from
    the basis, which always has as many columns as there are sizes.
    """
    m = len(sizes)
    basis = np.zeros((m, m))
    for i, size in enumerate(sizes):
        basis[i, i] = capacity // size
    x = np.array(demand, float) / basis.diagonal()
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        column, value = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, column)
        positive = direction > 1e-12
        ratio = np.where(positive, x / np.where(positive, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        basis[:, out] = column
    return [(tuple(int(v) for v in basis[:, j]), float(x[j])) for j in range(m)]


def best_configuration(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration that is worth most: a knapsack in which each size may repeat."""
    worth = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for i, size in enumerate(sizes):
        if prices[i] <= 0:
            continue
        # a size fits at most a few times, so repeats are added one copy at a time
        for _ in range(capacity // size):
            better = worth[:-size] + prices[i]
            gain = better > worth[size:] + 1e-12
            if not gain.any():
                break
            worth[size:][gain] = better[gain]
            choice[size:][gain] = i
    at = int(np.argmax(worth))
    column = np.zeros(len(sizes))
    value = worth[at]
    while at > 0 and choice[at] >= 0:
        column[choice[at]] += 1
        at -= sizes[choice[at]]
    total = float(column @ prices)
    return column, total if total > 0 else value


def make_plan(histogram: Mapping[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> Plan:
    """Place all pieces of a histogram {length: number}."""
    plan = Plan(capacity)
    classes: list[Class] = []
    histogram = {n: c for n, c in histogram.items() if c > 0}
    if full := histogram.pop(capacity, 0):
        plan.take(capacity, full, 0, 1, 0)
        plan.sequences = full
    large = sorted(((n, c) for n, c in histogram.items() if n > small), reverse=True)
    if large:
        parts = grouped(large, groups)
        sizes: list[int] = []
        merged: list[list[tuple[int, int]]] = []
        for part in parts:  # groups with the same largest length are one size
            if sizes and sizes[-1] == part[0][0]:
                merged[-1] += part
            else:
                sizes.append(part[0][0])
                merged.append(list(part))
        demand = [sum(n for _, n in part) for part in merged]
        for config, times in configurations(sizes, demand, capacity):
            use = int(times + 1e-9)
            if use:
                classes += _substitute(plan, config, use, merged)
        left: dict[int, int] = defaultdict(int)
        for part in merged:
            for length, n in part:
                left[length] += n
        classes = _best_fit(plan, classes, left)
    _best_fit(plan, classes, {n: c for n, c in histogram.items() if n <= small})
    return plan


def _substitute(plan: Plan, config: tuple[int, ...], use: int, parts: list[list[tuple[int, int]]]) -> list[Class]:
    """Fill ``use`` sequences of a configuration with actual pieces, longest first."""
    slots = [i for i, n in enumerate(config) for _ in range(n)]
    classes = [Class(plan.capacity, plan.sequences, use)]
    plan.sequences += use
    for i in slots:
        after: list[Class] = []
        for c in classes:
            while c.count:
                if not parts[i]:
                    after.append(c)
                    break
                length, n = parts[i][0]
                part = min(n, c.count)
                plan.take(length, part, c.first, 1, plan.capacity - c.room)
                after.append(Class(c.room - length, c.first, part))
                c = Class(c.room, c.first + part, c.count - part)
                if part == n:
                    parts[i].pop(0)
                else:
                    parts[i][0] = (length, n - part)
        classes = after
    return classes


def _best_fit(plan: Plan, classes: list[Class], histogram: Mapping[int, int]) -> list[Class]:
    """Place pieces, longest first, each into the least room that is enough."""
    classes = sorted(c for c in classes if c.count)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(classes, Class(length, -1, 0))
            if at == len(classes):
                each = plan.capacity // length
                count = max(1, left // each)
                insort(classes, Class(plan.capacity, plan.sequences, count))
                plan.sequences += count
                continue
            c = classes.pop(at)
            each = c.room // length
            whole = min(c.count, left // each)
            offset = plan.capacity - c.room
            if whole:
                plan.take(length, whole * each, c.first, each, offset)
                left -= whole * each
                insort(classes, Class(c.room - each * length, c.first, whole))
            if whole < c.count:
                first, count = c.first + whole, c.count - whole
                if left and left < each:
                    plan.take(length, left, first, left, offset)
                    insort(classes, Class(c.room - left * length, first, 1))
                    left, first, count = 0, first + 1, count - 1
                if count:
                    insort(classes, Class(c.room, first, count))
    return classes


# --- the operator ------------------------------------------------------------


def _ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, without gathering a length in one task.

    A piece has its number among those of its length in the task that made it; the table
    of where a task's numbers begin has a row per task and length that it made. Up to
    :data:`STARTS_SENT` rows it is sent to all tasks, which keeps the pieces where they
    are; a longer one is joined by a shuffle, whose large partitions can be split.
    """
    sizes = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    starts = written(starts, "pieces-starts")
    if starts.count() <= STARTS_SENT:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "part"])
    return ranked.withColumn("rank", F.col("before") + F.col("nth")).drop("part", "before", "nth")


def pack_ids(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    groups: int = GROUPS,
    small: int = SMALL,
) -> DataFrame:
    """Pack documents into sequences of ``capacity`` tokens: a row for each piece.

    (doc_id, piece, start, length, ids, sequence_id, offset). A document's ids are
    those of its text and ``end_id``; only longer documents are cut, into pieces of
    ``capacity`` tokens, the last may be shorter. ``ids`` holds those of the piece as
    little-endian unsigned 32-bit numbers: a sequence is its pieces' ids joined in the
    order of their offsets, which have no gaps. ``vocabulary`` is the path of a word
    tokenizer's file.

    A null or empty text has the end id alone. Ids are only carried along: null ids and
    repeated rows are documents like any other. An empty table gives an empty table.
    Other columns are left out.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    pieces = token_pieces(texts, "text", vocabulary, capacity, end_id)
    # numbers that stay as they are, since they are written
    pieces = written(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = make_plan(histogram, capacity, groups, small)
    entries = sorted(plan.entries, key=lambda e: (e.length, e.rank))
    table = np.array([[e.length, e.rank, e.sequence, e.each, e.offset] for e in entries], np.int64).reshape(-1, 5)
    lengths, ranks = table[:, 0], table[:, 1]

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(length), np.int64)
        for value in np.unique(length):
            low, high = np.searchsorted(lengths, [value, value + 1])
            own = length == value
            at[own] = low + np.searchsorted(ranks[low:high], rank[own], side="right") - 1
        _, first, sequence, each, offset = table[at].T if len(at) else np.zeros((5, 0), np.int64)
        n = rank - first
        return pa.StructArray.from_arrays(
            [pa.array(sequence + n // np.maximum(each, 1)), pa.array(offset + n % np.maximum(each, 1) * length)],
            names=["sequence_id", "offset"],
        )

    placed = _ranked(pieces).withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids", "place.sequence_id", "place.offset")


def digests(packed: DataFrame) -> DataFrame:
    """The rows of :func:`pack_ids` with the CRC32 of the ids in their place."""
    return packed.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def pack(docs: DataFrame, *args: Any, **options: Any) -> DataFrame:
    """The placement alone, with digests of the ids: :func:`pack_ids` for who has them already."""
    return digests(pack_ids(docs, *args, **options))
