"""Token ids in binary files: frequent ids in few bytes, widths apart from values.

An id is replaced by its rank among the ids of the whole corpus, most frequent first, so
that small numbers are common. A number takes one to four whole bytes; the widths of four
numbers share a control byte, and control bytes stand before the data bytes of their block.
So a reader looks the widths up in a table of 256 entries, sums them up to the places of the
numbers and gathers all numbers of a block at once.

A folder holds ``ranks.bin`` (ids by rank, unsigned 32-bit), files ``part-<shard>-<number>.ids``
and a Parquet table ``index`` with a row per file. Documents ascend by id over the shards and
within them. All numbers are little-endian. A file begins with ``MAGIC``, its shard and the
ids of the shard before it; blocks follow, each with whole documents: counts of documents,
ids and data bytes, the documents' ids, whether these are null, their lengths, control bytes
and data bytes.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any, BinaryIO

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.llm.common import BYTES_AT_ONCE, by_value, col, kept_in_worker, tidy_after, written
from lakemart.llm.numbering import PLACE_BITS, in_order
from lakemart.llm.packing import END_ID, VOCABULARY, WordTokenizer, groups_of
from lakemart.session import scratch_path

by_value(__name__)

MAGIC = b"RANKIDS1"
FILE = "<8sqq"
BLOCK = "<qqq"
RANKS = "ranks.bin"
INDEX = "index"
# A file ends after the block that brings it to this size, a block after this many ids.
FILE_BYTES = 32 << 20
BLOCK_IDS = 1 << 18


# --- numbers in bytes --------------------------------------------------------

# The widths of four numbers by control byte, the first number in the lowest bits.
WIDTHS = (1 + (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3)).astype(np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    more = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[: len(numbers)] = more
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) <= more[:, None]
    return control.tobytes(), numbers.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    widths = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(widths, dtype=np.int64)
    padded = np.frombuffer(data + bytes(4), np.uint8)
    # every place of the data read as four bytes
    wide = np.lib.stride_tricks.as_strided(padded.view("<u1"), (len(data) + 1, 4), (1, 1))
    return np.ascontiguousarray(wide[ends - widths]).view("<u4").ravel() & MASKS[widths]


# --- files -------------------------------------------------------------------


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file, as Hadoop or Python spells it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put(uri: str, content: Any) -> None:
    """Write a file at once or not at all; a task that runs again replaces it by the same."""
    system, path = place_of(uri)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(aside) as out:
        for part in content:
            out.write(part)
    system.move(aside, path)


class ShardWriter:
    """The files of one shard, from documents in their order."""

    def __init__(self, folder: str, shard: int, file_bytes: int, block_ids: int) -> None:
        self.folder, self.shard, self.file_bytes, self.block_ids = folder, shard, file_bytes, block_ids
        self.number = self.before = self.file_docs = self.file_ids = self.size = 0
        self.blocks: list[bytes] = []
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.ids = 0

    def add(self, doc_id: int | None, ranks: np.ndarray) -> Iterator[tuple]:
        if self.docs and self.ids + len(ranks) > self.block_ids:
            yield from self._block()
        self.docs.append((doc_id, ranks))
        self.ids += len(ranks)

    def _block(self) -> Iterator[tuple]:
        keys = [d[0] for d in self.docs]
        control, data = encode(np.concatenate([d[1] for d in self.docs]))
        head = struct.pack(BLOCK, len(keys), self.ids, len(data))
        names = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
        nulls = bytes(k is None for k in keys)
        lengths = np.array([len(d[1]) for d in self.docs], "<i8").tobytes()
        self.blocks.append(b"".join([head, names, nulls, lengths, control, data]))
        self.size += len(self.blocks[-1])
        self.file_docs += len(keys)
        self.file_ids += self.ids
        self.docs, self.ids = [], 0
        if self.size >= self.file_bytes:
            yield self._file()

    def _file(self) -> tuple:
        name = f"part-{self.shard:05d}-{self.number:05d}.ids"
        put(f"{self.folder}/{name}", [struct.pack(FILE, MAGIC, self.shard, self.before), *self.blocks])
        row = (self.shard, self.number, name, self.file_docs, self.file_ids)
        self.number, self.before = self.number + 1, self.before + self.file_ids
        self.blocks, self.size, self.file_docs, self.file_ids = [], 0, 0, 0
        return row

    def close(self) -> Iterator[tuple]:
        if self.docs:
            yield from self._block()
        if self.blocks:
            yield self._file()


def blocks_of(source: BinaryIO) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(shard, ids of the shard before, document ids, lengths, ranks) of each block of a file."""
    magic, shard, before = struct.unpack(FILE, source.read(struct.calcsize(FILE)))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    while head := source.read(struct.calcsize(BLOCK)):
        docs, n, size = struct.unpack(BLOCK, head)
        names = np.frombuffer(source.read(8 * docs), "<i8").tolist()
        nulls = source.read(docs)
        lengths = np.frombuffer(source.read(8 * docs), "<i8")
        ranks = decode(source.read(-(-n // 4)), source.read(size), n)
        yield shard, before, [None if x else k for k, x in zip(names, nulls, strict=True)], lengths, ranks
        before += n


# --- the operator ------------------------------------------------------------


def vocabulary_size(path: str) -> int:
    rules = json.loads(Path(path).read_text())
    return 1 + max([*rules["model"]["vocab"].values(), *[t["id"] for t in rules.get("added_tokens", [])]])


def _coded(docs: DataFrame, vocabulary: str, end_id: int, width: str) -> DataFrame:
    """(doc_id, hash, ids) per document and, in a row of its own per task, the counts of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_in_worker((VOCABULARY, vocabulary), lambda: WordTokenizer(vocabulary))
        end = np.array([end_id], "<u4").tobytes()
        counts = np.zeros(0, np.int64)

        def out(keys: pa.Array, ids: list[bytes | None], total: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(ids, pa.binary()), pa.array([total] * len(keys), pa.list_(pa.int64()))],
                names=["doc_id", "ids", "counts"],
            )

        for batch in batches:
            begin = 0
            for group in groups_of(batch.column(1)):
                parts = [ids + end for ids in tokenizer.all_ids(group)]
                ids = np.frombuffer(b"".join(parts), "<u4")
                new = np.bincount(ids)
                if len(new) > len(counts):
                    counts, new = new, counts
                counts[: len(new)] += new
                narrow = ids.astype(width).tobytes()
                each = np.dtype(width).itemsize
                ends = np.cumsum([0, *[len(p) // 4 * each for p in parts]]).tolist()
                narrow_parts = [narrow[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                yield out(batch.column(0).slice(begin, len(parts)), narrow_parts, None)
                begin += len(parts)
        tokenizer.forget()
        if len(counts):
            yield out(pa.nulls(1, pa.int64()), [None], counts.tolist())

    found = docs.mapInArrow(tidy_after(run), "doc_id bigint, ids binary, counts array<bigint>")
    return found.select("doc_id", F.xxhash64("ids").alias("hash"), "ids", "counts")


def write(
    docs: DataFrame,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
    block_ids: int = BLOCK_IDS,
) -> str:
    """Write the token ids of all texts in ascending order of document ids; the folder's name.

    ``folder`` must be new; by default it is one below the shared checkpoint folder. A
    document's ids are those of its text and ``end_id``; a null or empty text has the end
    id alone, texts may have any length. Document ids are whole numbers. Null ones come
    first; rows with the same id go by a hash of their token ids, and repeated rows are
    documents like any other. An empty table gives a folder without parts. Other columns
    are left out.

    What reaches the driver is a count per id of the vocabulary. A task writes its files
    as it goes and holds one file at most; files that a lost task wrote are written again.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-ids")
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    width = "<u2" if max(vocabulary_size(vocabulary), end_id + 1) <= 1 << 16 else "<u4"
    texts = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    coded = written(_coded(texts, vocabulary, end_id, width), "token-ids-coded")
    counts = coded.where("counts is not null").select(F.posexplode("counts").alias("id", "n"))
    totals = counts.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").collect()
    ids = np.array([r["id"] for r in sorted(totals, key=lambda r: (-r["n"], r["id"]))], "<u4")
    put(f"{folder}/{RANKS}", [ids.tobytes()])
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: ShardWriter | None = None

        def rows(files: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for row in files:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        names = ["shard", "number", "name", "docs", "ids"]
        schema = pa.schema([(n, pa.string() if n == "name" else pa.int64()) for n in names])
        for batch in batches:
            for key, part, place in zip(*batch.columns, strict=True):
                if writer is None:
                    writer = ShardWriter(folder, place.as_py() >> PLACE_BITS, file_bytes, block_ids)
                ranks = rank_of[np.frombuffer(part.as_buffer(), width)]
                yield from rows(writer.add(key.as_py(), ranks))
        if writer is not None:
            yield from rows(writer.close())

    ordered = in_order(coded.where("ids is not null").drop("counts"), [], ["doc_id", "hash"], "place")
    index = ordered.select("doc_id", "ids", "place").mapInArrow(
        tidy_after(run), "shard bigint, number bigint, name string, docs bigint, ids bigint"
    )
    index.write.parquet(f"{folder}/{INDEX}")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in a folder of :func:`write`.

    ``start`` counts the ids of all documents before it, ``ids`` are unsigned 32-bit.
    The driver reads the table of ranks and a total per shard, as many as there were
    partitions; tasks read their files block by block.
    """
    system, path = place_of(f"{folder}/{RANKS}")
    with system.open_input_stream(path) as source:
        table = np.frombuffer(source.read(), "<u4")
    index = spark.read.schema("shard bigint, number bigint, name string, docs bigint, ids bigint")
    totals = index.parquet(f"{folder}/{INDEX}").groupBy("shard").agg(F.sum("ids").alias("ids")).collect()
    starts, before = {}, 0
    for shard, ids in sorted((r["shard"], r["ids"]) for r in totals):
        starts[shard], before = before, before + ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0):
                files, name = place_of(uri.as_py())
                with files.open_input_stream(name) as source:
                    for shard, start, keys, lengths, ranks in blocks_of(source):
                        yield from documents(starts[shard] + start, keys, lengths, table[ranks])

    def documents(start: int, keys: list, lengths: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(lengths)
        begins = ends - lengths
        begin = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and 4 * (ends[i] - begins[begin]) < BYTES_AT_ONCE:
                continue
            offsets = pa.array(4 * (np.r_[begins[begin:i], ends[i - 1]] - begins[begin]), pa.int64())
            data = pa.py_buffer(ids[begins[begin] : ends[i - 1]].astype("<u4").tobytes())
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), i - begin, [None, offsets.buffers()[1], data])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[begin:i], pa.int64()),
                    pa.array(start + begins[begin:i], pa.int64()),
                    pa.array(lengths[begin:i], pa.int64()),
                    packed.cast(pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )
            begin = i

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not starts:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder)
    return files.select("path").mapInArrow(tidy_after(run), schema)
