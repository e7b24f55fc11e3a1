"""Counts against brute force, what expectation-maximisation finds, and verdicts against labels."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from lakemart.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def texts():
    rng = random.Random(2)
    words = ["a", "bb", "#c", "d*", "é日", "x y", "z\x1cz", "|"]
    gaps = [" ", "\n", "\t", " \n", "\r\n", "\x0b"]
    found = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([3, 40, 200]))) for _ in range(60)]
    return [None, "", " \n ", *found, "a b c a b c", "x y x y x", "line\nline\n line\nline", "For " * 300, "w " * 49, "x" * 5000]


def test_counts_equal_brute_force(docs_of):
    rows = list(enumerate(texts())) + [(None, "one two"), (3, "same"), (3, "same")]
    found = quality.score(docs_of(rows)).collect()
    got = sorted((str(r["doc_id"]), *r["quality"][:5]) for r in found)
    assert got == sorted((str(i), *brute(t)) for i, t in rows)
    for r in found:
        n, *_, repeated = brute(r["text"])
        assert r["quality"]["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert 0 <= r["quality"]["probability"] <= 1
        assert not (r["quality"]["base_failed"] and r["quality"]["kept"])


def test_verdicts_against_labels(spark, small_dir):
    where = small_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet").withColumnRenamed("quality", "truth")
    rows = quality.score(docs).join(labels, "doc_id").collect()
    judged = [(r["truth"], r["quality"]["kept"]) for r in rows if r["quality"]["n_words"] >= 50]
    good = [kept for truth, kept in judged if truth]
    bad = [kept for truth, kept in judged if not truth]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_estimate_recovers_planted_figures():
    rng = np.random.default_rng(0)
    n, rules = 20_000, 6
    bad = rng.random(n) < 0.15
    kind = rng.integers(0, rules, n)
    votes = np.where(rng.random((n, rules)) < 0.98, 1, -1)
    votes[bad, kind[bad]] = np.where(rng.random(bad.sum()) < 0.95, -1, 1)
    votes[rng.random((n, rules)) < 0.1] = 0
    found, weight = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(found, weight)
    assert abs(model.share[0] - 0.85) < 0.07
    assert all(p > 0.95 for p in model.says_good[0])
    quiet = model.probability(np.array([[1] * rules, [-1, -1, -1, 1, 1, 1]]))
    assert quiet[0] > 0.9 and quiet[1] < 0.5


def test_estimate_without_documents():
    model = quality.estimate(np.zeros((0, 4)), np.zeros(0))
    assert abs(model.share[0] - 0.9) < 1e-9


def test_keep_good_empty_and_clashing_columns(spark, docs_of):
    assert quality.keep_good(docs_of([])).collect() == []
    prose = " ".join(f"the word{i} of a thing{i * 7} was in place{i * i} and" for i in range(30))
    docs = spark.createDataFrame([(1, prose, 5, "v"), (2, "short", 6, "w")], "quality int, text string, counts int, votes string")
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == [(1, prose, 5, "v")]
