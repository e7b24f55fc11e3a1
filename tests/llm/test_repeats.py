"""Removing repeated windows of words and strings of bytes, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemart.llm import anchors, sketches, substrings, suffixes

NONE_FIRST = -(1 << 63)


def corpus():
    rng = random.Random(11)
    words = [f"{rng.choice('abcde')}{i}" for i in range(200)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(40):
        body = [" ".join(rng.choices(words, k=rng.choice([5, 30, 90]))) for _ in range(3)]
        if i % 3 == 0:
            body.insert(rng.randrange(4), passage)
        if i % 5 == 0 and rows:
            body.append(rng.choice(rows)[1])
        rows.append((rng.randrange(1000) * 2 + 1, "\n  ".join(body)))
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(None, passage), (None, passage), (4, None), (6, ""), (8, " \t\n "), (10, "ä" * 300), (12, "ä" * 299 + "b")]
    rows += [(14, "For " * 400), (16, "x" * 120), (18, "y" + "x" * 120), (20, passage.replace(" ", "\t"))]
    return rows


def identities(rows):
    """Documents: rows with the same id and text count once, null ids come first."""
    return sorted({(NONE_FIRST if i is None else i, t or "") for i, t in rows})


def brute_words(rows, n=20):
    words = {d: re.findall(rb"[^\x20\x09-\x0d]+", d[1].encode()) for d in identities(rows)}
    docs = list(words)
    seen, gone = set(), {d: set() for d in docs}
    for d in docs:
        for j in range(len(words[d]) - n + 1):
            window = tuple(words[d][j : j + n])
            if window in seen:
                gone[d].update(range(j, j + n))
            seen.add(window)
    out = {}
    for d in docs:
        kept = [w for j, w in enumerate(words[d]) if j not in gone[d]]
        out[d] = (len(words[d]), len(gone[d]), hashlib.sha256(b" ".join(kept)).hexdigest())
    return sorted((str(i), *out[(NONE_FIRST if i is None else i, t or "")]) for i, t in rows)


def brute_bytes(rows, n=50):
    docs = identities(rows)
    first = {}
    for i, t in docs:
        data = t.encode()
        for j in range(len(data) - n + 1):
            first[data[j : j + n]] = min(i, first.get(data[j : j + n], i))
    out = []
    for i, t in rows:
        data, me = (t or "").encode(), NONE_FIRST if i is None else i
        gone = np.zeros(len(data) + 1, bool)
        for j in range(len(data) - n + 1):
            if first[data[j : j + n]] < me:
                gone[j : j + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone[:-1], strict=True) if not g)
        out.append((str(i), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def of_words(found):
    """(id, words, removed, digest of the kept words)."""
    out = []
    for r in found.collect():
        n, gone, kept = r["repeats"]
        words = re.findall(rb"[^\x20\x09-\x0d]+", (kept or "").encode())
        out.append((str(r["doc_id"]), n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
    return sorted(out)


def of_bytes(found):
    """(id, bytes, removed, spans, digest of the kept bytes)."""
    rows = [(str(r["doc_id"]), *r["shared"]) for r in found.collect()]
    return sorted((*row[:4], hashlib.sha256(bytes(row[4])).hexdigest()) for row in rows)


def test_words_equal_brute_force(docs_of, monkeypatch):
    rows = corpus()
    found = substrings.remove_repeats(docs_of(rows))
    # rows with one id and different texts have an order of their own, so none is in the data
    got = of_words(found)
    assert got == brute_words(rows)
    assert any(gone for _, _, gone, _ in got)


def test_kept_text_is_cut_out_of_the_text(docs_of):
    """What loses nothing stays as it is; elsewhere what stays has its white space, too."""
    for r in substrings.remove_repeats(docs_of(corpus())).collect():
        kept = r["repeats"]["kept"]
        assert r["repeats"]["n_removed"] > 0 or kept == r["text"]
        parts = re.findall(r"\S+\s*", kept or "")
        assert all(part in r["text"] for part in parts)


def test_bytes_equal_brute_force(docs_of):
    rows = corpus()
    found = suffixes.remove_shared(docs_of(rows))
    assert of_bytes(found) == brute_bytes(rows)


def test_crowded_anchors_give_the_same(docs_of):
    rows = corpus()
    found = substrings.remove_repeats(docs_of(rows), crowd=2)
    assert of_words(found) == brute_words(rows)
    found = suffixes.remove_shared(docs_of(rows), crowd=2)
    assert of_bytes(found) == brute_bytes(rows)


def test_small_steps_give_the_same(docs_of, monkeypatch):
    """Long documents are cut into pieces, and tasks pass on what they hold."""
    rows = corpus()
    monkeypatch.setattr(anchors, "UNITS_AT_ONCE", 64)
    monkeypatch.setattr(anchors, "HELD", 50)
    monkeypatch.setattr(sketches, "HELD", 70)
    monkeypatch.setattr(sketches, "WINDOW_CELLS", 64)
    monkeypatch.setattr(suffixes, "STRETCHES_HELD", 7)
    monkeypatch.setattr(suffixes, "BYTES_SORTED", 200)
    monkeypatch.setattr(substrings, "BYTES_AT_ONCE", 100)
    found = suffixes.remove_shared(docs_of(rows))
    assert of_bytes(found) == brute_bytes(rows)
    found = substrings.remove_repeats(docs_of(rows))
    assert of_words(found) == brute_words(rows)


def test_same_id_different_texts_do_not_fail(docs_of):
    rows = [(1, "a b c " * 30), (1, "a b c " * 40), (2, "a b c " * 10)]
    assert len(substrings.remove_repeats(docs_of(rows)).collect()) == 3
    for r in suffixes.remove_shared(docs_of(rows)).collect():
        assert (r["shared"]["n_removed"] > 0) == (r["doc_id"] == 2)


def test_clashing_columns(spark):
    names = "doc_id bigint, text string, key string, id string, print string, places string, marks string, _key int, repeats int, shared int, _MARKS int"
    rows = [(i, "w " * 60 + str(i), "k", "i", "p", "q", "m", 1, 2, 3, 4) for i in (1, 2)]
    docs = spark.createDataFrame(rows, names)
    for found, alias in ((substrings.remove_repeats(docs), "repeats"), (suffixes.remove_shared(docs), "shared")):
        assert found.columns == docs.columns
        assert {r["doc_id"]: r[alias]["n_removed"] > 0 for r in found.collect()} == {1: alias == "repeats", 2: True}


def test_a_very_long_text(docs_of):
    """Longer than all steps at their own sizes: it repeats itself and what others have."""
    long = " ".join(f"w{i % 90_001}" for i in range(400_000))
    rows = [(1, " ".join(f"w{i}" for i in range(500, 560))), (2, long), (3, long[:300])]
    got = {r["doc_id"]: r["repeats"] for r in substrings.remove_repeats(docs_of(rows)).collect()}
    assert got[2]["n_words"] == 400_000 and got[2]["n_removed"] == 400_000 - 90_001 + 60
    assert got[2]["kept"].split() == [f"w{i}" for i in range(90_001) if not 500 <= i < 560]
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] > 0
    shared = {r["doc_id"]: r["shared"] for r in suffixes.remove_shared(docs_of(rows)).collect()}
    assert shared[2]["n_bytes"] == len(long) and shared[2]["n_removed"] == long.count(rows[0][1]) * len(rows[0][1])
    assert shared[3]["n_removed"] == 300 and bytes(shared[3]["kept"]) == b""


def test_empty_table(docs_of):
    assert substrings.remove_repeats(docs_of([])).collect() == []
    assert suffixes.remove_shared(docs_of([])).collect() == []


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256)), b"\xff\x00"])
def test_suffix_order_equals_sorting(alphabet):
    rng = random.Random(5)
    for size in (1, 2, 7, 200):
        text = bytes(rng.choices(alphabet, k=size)) + bytes(20)
        wanted = np.zeros(len(text), bool)
        wanted[: size] = rng.choices([True, False], k=size)
        order = suffixes.suffix_order(np.frombuffer(text, np.uint8), wanted, 12)
        keys = [text[i : i + 12] for i in order]
        assert keys == sorted(keys) and sorted(order) == np.flatnonzero(wanted).tolist()
        if len(order):
            lengths = suffixes.common_prefixes(order, suffixes.eights(np.frombuffer(text + bytes(16), np.uint8)), 12)
            for a, b, n in zip(keys, keys[1:], lengths[1:], strict=False):
                assert a[:n] == b[:n] and (n == 12 or a[n] != b[n])


@pytest.mark.parametrize("cells", [4, 64, 1 << 16])
def test_merged_sketches_never_underestimate(monkeypatch, cells):
    """Whatever the width; and a wide sketch hardly overestimates."""
    monkeypatch.setattr(sketches, "WINDOW_CELLS", cells)
    monkeypatch.setattr(sketches, "ANCHOR_CELLS", cells)
    rng, shards = np.random.default_rng(2), 3
    parts = [anchors.mix(rng.integers(1, 3000, 500).astype(np.uint64)) for _ in range(4)]
    rows = (*sketches.WINDOW_ROWS, sketches.ANCHOR_ROW)
    sent = [(p, row, *x) for p, hashes in enumerate(parts) for row in rows for x in sketches.partial(hashes, row, shards)]
    total = {
        (row, shard): sketches.merged(row, [x[3:] for x in sent if x[1:3] == (row, shard)])
        for row, shard in {x[1:3] for x in sent}
    }
    every = np.concatenate(parts)
    for p, hashes in enumerate(parts):
        answer = []
        for _, row, shard, data, _ in (x for x in sent if x[0] == p):
            at = sketches.unpacked(data)
            count = total[row, shard][at]
            answer.append({"row": row, "shard": shard, "cells": sketches.packed(at[count > 1])})
            if row == sketches.ANCHOR_ROW:
                answer.append({"row": sketches.CROWDED, "shard": shard, "cells": sketches.packed(at[count > 3])})
        known = sketches.Estimates(answer, shards)
        occurs = np.array([(every == h).sum() for h in hashes])
        hit, crowded = known.repeated(hashes, hashes), known.crowded(hashes)
        assert hit[occurs > 1].all() and crowded[occurs > 3].all()
        if cells > 1 << 10:
            assert hit[occurs == 1].sum() < 10 and crowded[occurs <= 3].mean() < 0.1


def test_counts_of_a_cell_stop_at_the_largest_number():
    hashes = np.full(1000, 7, np.uint64)
    for row in (0, sketches.ANCHOR_ROW):
        ((_, cells, counts),) = sketches.partial(hashes, row, 1)
        assert sketches.merged(row, [(cells, counts)] * 3)[sketches.unpacked(cells)[0]] == (255 if row == 0 else 3000)


def test_only_windows_estimated_repeated_are_grouped(docs_of, monkeypatch):
    """Nothing of documents that share nothing is held for repeated."""
    docs = docs_of([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(30)])
    wide, names = anchors.keyed(docs, "doc_id", "text")
    names |= {"part": "part", "found": "found"}
    kind = anchors.Units(substrings.word_hashes, 20, 8)
    spread = wide.repartition(names["key"])
    found = sketches.answers(spread, names, "text", kind, 1000)
    assert [r["found"] for r in found.collect() if r["found"]] == []
    met = sketches.with_answers(spread, names, "text", found).collect()
    assert len(met) == 30 and {r["part"] for r in met} == {r["part"] for r in met if r["found"] is not None}


@pytest.mark.parametrize("crowd", [2, substrings.CROWD])
def test_documents_without_an_answer_lose_nothing(docs_of, monkeypatch, crowd):
    """As after the split of a skewed partition: some parts have an answer, others don't."""
    answers = sketches.answers
    monkeypatch.setattr(sketches, "answers", lambda *a: answers(*a).where(F.col(a[1]["key"]) % 2 == 0))
    rows = corpus()
    assert of_words(substrings.remove_repeats(docs_of(rows), crowd=crowd)) == brute_words(rows)


def test_documents_are_dealt_once(docs_of):
    """The sketches, the second pass and the removal share one shuffle of the documents."""
    found = substrings.remove_repeats(docs_of(corpus()))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("ReusedExchange") >= 2


def test_rolled_and_sliding_minimum():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    base = int(anchors._GRAM_BASE)
    for width in (1, 2, 7, 8, 20, 50):
        wanted = [sum(int(x[i + j]) * base**j for j in range(width)) % (1 << 64) for i in range(101 - width)]
        assert anchors.rolled(x, width).tolist() == wanted
        assert anchors.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(101 - width)]
