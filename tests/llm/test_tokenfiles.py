from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from __spark_entry__ import queries
from lakemart.llm import tokenfiles


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(library, rows):
    """(doc_id, start, n_tokens, ids) by the library, in ascending order."""
    out, start = [], 0
    coded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    for i, ids in sorted(coded, key=lambda c: (c[0] is not None, c[0] or 0)):
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


def stored(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = tokenfiles.write(docs, **options)
    found = tokenfiles.read(spark, folder).collect()
    return folder, [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_numbers_come_back(numbers):
    control, data = tokenfiles.encode(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, -(-n.bit_length() // 8)) for n in numbers)
    assert tokenfiles.decode(control, data, len(numbers)).tolist() == numbers


def test_layout_of_a_block():
    """Widths minus one in two bits each, the first number lowest; data little-endian."""
    control, data = tokenfiles.encode(np.array([5, 0x1234, 0x123456, 0x12345678, 7], np.uint32))
    assert control == bytes([0b11100100, 0])
    assert data == bytes([5, 0x34, 0x12, 0x56, 0x34, 0x12, 0x78, 0x56, 0x34, 0x12, 7])


@pytest.mark.parametrize("options", [{}, {"file_bytes": 200, "block_ids": 20}])
def test_round_trip_through_files(spark, library, options):
    texts = ["Hello world", None, "", "a b " * 30, "Ünïcode 漢字 <|endoftext|>", "\t\n", "long " * 3000, "x" * 5000]
    rows = [((i * 37) % 100 - 20, texts[i % len(texts)]) for i in range(100)] + [(None, "no id")]
    folder, found = stored(spark, rows, **options)
    assert sorted(found, key=lambda r: r[1]) == plain(library, rows)
    sizes = {p.name: p.stat().st_size for p in Path(folder.removeprefix("file:")).glob("*.ids")}
    index = {r["name"]: r for r in spark.read.parquet(f"{folder}/index").collect()}
    assert set(index) == set(sizes) and sum(r["docs"] for r in index.values()) == 101
    if options:
        assert len(sizes) > 20


def test_ids_are_ranked_by_frequency_over_all(spark, library):
    rows = [(i, "the the the cat" if i % 2 else "dog the") for i in range(50)]
    folder, _ = stored(spark, rows)
    table = np.fromfile(f"{folder.removeprefix('file:')}/ranks.bin", "<u4").tolist()
    ids = [x for _, t in rows for x in [*library.encode(t, add_special_tokens=False).ids, 1]]
    assert table == sorted(set(ids), key=lambda x: (-ids.count(x), x))


def test_repeated_ids_and_rows(spark, library):
    rows = [(3, "b"), (3, "a a"), (3, "b"), (1, "c"), (1, None)]
    _, found = stored(spark, rows)
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == [1, 1, 3, 3, 3]
    assert sorted((r[0], r[3]) for r in found) == sorted((r[0], r[3]) for r in plain(library, rows))
    assert [r[1] for r in found] == [sum(r[2] for r in found[:i]) for i in range(5)]


def test_empty_table_and_clashing_columns(spark, library):
    assert stored(spark, []) [1] == []
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    for name in ("ids", "counts", "hash", "place", "shard", "start"):
        docs = docs.withColumn(name, F.lit("x"))
    found = tokenfiles.read(spark, tokenfiles.write(docs)).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in found] == [(1, 2), (2, 1)]


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"something else, much longer")
    with (tmp_path / "x").open("rb") as source, pytest.raises(ValueError, match="not a file"):
        next(tokenfiles.blocks_of(source))


def test_vocabulary_size_counts_added_tokens(tmp_path):
    rules = {"model": {"vocab": {"a": 0, "b": 70_000}}, "added_tokens": [{"id": 70_001, "content": "c"}]}
    (tmp_path / "v.json").write_text(json.dumps(rules))
    assert tokenfiles.vocabulary_size(str(tmp_path / "v.json")) == 70_002


def test_query_equals_the_library(spark, library, small_dir):
    """The whole table of the smallest size, through the query."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in queries()["op11_token_files"](spark, small_dir).collect())
    want = [(i, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in plain(library, rows)]
    assert found == sorted(want)
