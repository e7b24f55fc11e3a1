"""Token ids against the tokenizers library, plans against their rules and lower bounds."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakemart.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)

TEXTS = [
    "",
    " \n\t ",
    "The QUICK brown fox's 12,345 jumps!!! don't they'll",
    "Straße ÀÉÎ ÿ µ ª º ² ½ × ÷ ¿¡  x ­ y",
    "İstanbul ΣΑΣ ǅ ﬁ é ́ a b \x0b c \x1c d \x85 e",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|> <| x",
    "日本語 テスト 😀👍🏽 \x00\x01 z\x01z",
    "word" * 2000,
    "x" * 3000 + " " + "é" * 500,
    "aaa aaaa aaaaa ababab !!!!!! ...... ------ 'S 'Ll ''' 's",
    "\r\na\rb\r\n",
]


def random_texts(n):
    rng = random.Random(3)
    letters = "aabcdeehiilnoprstu,.'!-12 AEST\näöüéß"
    return ["".join(rng.choices(letters, k=rng.choice([5, 60, 700]))) for _ in range(n)]


def reference(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("remembered", [packing.WORDS_REMEMBERED, 3])
def test_ids_equal_the_library(monkeypatch, remembered):
    monkeypatch.setattr(packing, "WORDS_REMEMBERED", remembered)
    texts = TEXTS + random_texts(200) + ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x300, 64)]
    tokenizer = packing.WordTokenizer(PATH)
    found = [np.frombuffer(tokenizer.ids(t), "<u4").tolist() for t in texts]
    assert found == reference(texts)


def place_all(plan):
    """Pieces by sequence, from the entries of a plan."""
    found = defaultdict(list)
    for e in plan.entries:
        for n in range(e.count):
            found[e.sequence + n // e.each].append((e.offset + n % e.each * e.length, e.length))
    return found


def check_plan(histogram, capacity, **options):
    plan = packing.make_plan(histogram, capacity, **options)
    found = place_all(plan)
    assert len(found) == plan.sequences
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(n for parts in found.values() for _, n in parts) == Counter(
        {n: c for n, c in histogram.items() if c}
    )
    for length in histogram:
        ranks = sorted((e.rank, e.count) for e in plan.entries if e.length == length)
        assert all(a + n == b for (a, n), (b, _) in zip(ranks, ranks[1:], strict=False))
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plans_keep_the_rules(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 4096])
    histogram = {rng.randint(1, capacity): rng.randint(0, 500) for _ in range(rng.choice([1, 5, 200]))}
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    found = check_plan(histogram, capacity, groups=rng.choice([1, 5, 20]), small=capacity // 3)
    assert found >= least


def test_plans_are_near_the_lower_bound():
    rng = random.Random(1)
    lengths = [min(4096, int(rng.lognormvariate(6.3, 1))) or 1 for _ in range(20000)]
    histogram = Counter(lengths)
    assert check_plan(histogram, 4096) <= -(-sum(lengths) // 4096) * 1.002 + 1
    # thirds and halves fit exactly
    assert check_plan({50: 40, 30: 40, 20: 40}, 100, groups=3, small=10) == 40


def test_empty_plan():
    assert packing.make_plan({}).sequences == 0


def test_pack(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS + random_texts(60))]
    rows += [(None, "null id"), (None, None), (7, "again"), (7, "again"), (5, "long " * 9000)]
    found = packing.pack(docs_of(rows)).collect()
    assert set(found[0].asDict()) == {
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    }
    wanted = Counter()
    for (i, _), ids in zip(rows, reference([t or "" for _, t in rows]), strict=True):
        ids = [*ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in found) // 4096) + 1


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert packing.pack(docs_of([])).collect() == []
    clash = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id int, text string, row int, length int")
    assert packing.pack(clash).count() == 1


def test_sequences_hold_the_ids(docs_of):
    """Joined by their offsets, the ids of a sequence can be trained on as they are."""
    rows = list(enumerate(TEXTS + random_texts(20) + ["long " * 9000]))
    found = packing.pack_ids(docs_of(rows)).collect()
    wanted = [[*ids, packing.END_ID] for ids in reference([t for _, t in rows])]
    sequences = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(sequences[r["sequence_id"]]) == r["offset"]
        sequences[r["sequence_id"]] += ids
    assert Counter(x for ids in sequences.values() for x in ids) == Counter(x for ids in wanted for x in ids)


def test_long_tables_of_starts_are_joined_alike(docs_of, monkeypatch):
    """Beyond the rows that are sent to all tasks a shuffle gives the same ranks."""
    rows = list(enumerate(TEXTS + random_texts(40)))
    wanted = sorted(map(str, packing.pack(docs_of(rows)).drop("sequence_id", "offset").collect()))
    monkeypatch.setattr(packing, "STARTS_SENT", 0)
    found = packing.pack(docs_of(rows).repartition(5)).collect()
    places = {(r["sequence_id"], r["offset"]) for r in found}
    assert len(places) == len(found)
    assert sorted(str(r) for r in docs_of([]).sparkSession.createDataFrame(found).drop("sequence_id", "offset").collect()) == wanted
