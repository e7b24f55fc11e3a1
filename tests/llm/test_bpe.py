"""Byte-pair codes against the tokenizers library, and exact round trips."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakemart.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tok():
    return bpe.ByteTokenizer(PATH)


def texts():
    rng = random.Random(9)
    kinds = [
        "abcdefghijklmnopqrstuvwxyz",  # one unsplit run
        "ab",
        " ",
        " \n\t",
        "aeinrst    ''ldmve.!?0123456789\n",
        "é日本語😀 aß́",
        "!?.-=*#",
        "0123456789",
    ]
    found = ["".join(rng.choices(k, k=n)) for k in kinds for n in (1, 90, 700, 2000)]
    found += ["the " * 500, "x" * 3000, " " * 1500 + "y" + " " * 700, "don't we'll they're " * 60]
    found += ["ab<|endoftext|>cd " * 40, "<|endoftext|>" * 60, "<|endoftext" * 50, "a\r\n\r\n  b " * 100]
    words = ["the", "ing", "token", "ization", "'s", "Über", "naïve", "\n\n", "  ", "12", "3.14"]
    found += [" ".join(rng.choices(words, k=400)), "".join(rng.choices(words, k=600))]
    return ["", " ", *found]


def test_whole_texts_equal_the_library(library, tok):
    for t in texts() + ["".join(map(chr, range(a, a + 97))) for a in range(0, 0x400, 61)]:
        ids = tok.ids(t)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert tok.text(ids) == t == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [7, 40, 333])
def test_parts_put_together_equal_the_library(monkeypatch, library, tok, leaf):
    monkeypatch.setattr(bpe, "FIRST_WINDOW", 4)
    for t in texts():
        ranges = bpe.halves(len(t), leaf)
        assert "".join(t[a:b] for a, b in ranges) == t and all(b - a <= leaf for a, b in ranges)
        parts = [(tok.ids(t[a:b]), t[a:b].encode()) for a, b in ranges]
        assert bpe.joined_all(parts, tok).tolist() == library.encode(t, add_special_tokens=False).ids


def test_encode_and_decode(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += [(None, None, None), (0, None, "x"), (3, rows[9][1], "y"), (3, rows[9][1], "y"), (4, "word " * 900, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, digest string")
    found = bpe.decode(bpe.encode(docs, leaf=500), alias="back")
    assert found.columns == ["doc_id", "text", "digest", "ids", "back"]
    got = found.collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["digest"]) for r in got))) == sorted(map(str, rows))
    for r in got:
        wanted = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == wanted
        assert r["back"] == (r["text"] or "")


def test_empty_table_and_own_output(spark):
    docs = spark.createDataFrame([], "text string, ids string")
    assert bpe.encode(docs).collect() == []
    docs = spark.createDataFrame([("a b" * 40, "old")], "text string, ids string")
    twice = bpe.encode(bpe.encode(docs, leaf=20), leaf=20)
    assert twice.columns == ["text", "ids"] and len(twice.collect()[0]["ids"]) > 0
