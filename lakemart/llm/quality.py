"""Quality rules combined by weak supervision.

Every rule looks at one property of a text and votes *good* (+1), *bad* (-1) or
abstains (0). No rule decides alone: expectation-maximisation over the votes of the
whole corpus estimates how often each rule is right and how many documents are good
or bad in one way or another, and a document is kept when the posterior probability
that it is good reaches a threshold.

The votes of all documents are first counted per combination of votes. There are at
most 3**len(RULES) combinations however many documents there are, so the estimate
runs on a table of bounded size and the documents never leave the executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, col, fresh, tidy

by_value(__name__)

SYMBOLS = "#*$%&|<>"
WORD_SPACE = " \t\n\v\f\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

# Frequent function words of the languages expected in the corpus.
FUNCTION_WORDS = frozenset(
    word.encode()
    for word in (
        "a and are as at be by for from in is it of on or that the this to was with "
        "au dans de des du elle en est et la le les ou par pas pour qui sur un une "
        "das der des die ein eine für ich ist mit nicht sich sie und von zu den dem "
        "con del el ella es los las no para por que se su una y"
    ).split()
)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_shouts", "n_distinct", "n_function",
)


def repeated_words(words: Sequence[bytes], width: int = 3) -> int:
    """Words inside a ``width``-word window that occurs at least twice."""
    windows = list(zip(*[words[i:] for i in range(width)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, upto = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + width - max(i, upto)
            upto = i + width
    return covered


def count_text(text: str | None) -> tuple[int, ...]:
    """The numbers the rules look at, in the order of :data:`COUNTS`."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(WORD_SPACE)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in WORD_SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, DIGITS)),
        text.count("!"),
        len(set(words)),
        sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())),
    )


Counts = Mapping[str, np.ndarray]


@dataclass(frozen=True)
class Rule:
    """Votes good up to one bound of a ratio, bad from another, and abstains between.

    ``good`` below ``bad`` means that small values are good, and the other way round.
    Documents shorter than ``min_words`` get no vote.
    """

    name: str
    ratio: Callable[[Counts], np.ndarray]
    good: float
    bad: float
    min_words: int = 1

    def vote(self, c: Counts) -> np.ndarray:
        x, sign = self.ratio(c), 1 if self.good < self.bad else -1
        votes = (sign * x <= sign * self.good).astype(np.int8) - (sign * x >= sign * self.bad)
        return np.where(c["n_words"] < self.min_words, 0, votes).astype(np.int8)


def _per(part: str, whole: str) -> Callable[[Counts], np.ndarray]:
    return lambda c: c[part] / np.maximum(c[whole], 1)


RULES = (
    Rule("long enough", lambda c: c["n_words"], good=60, bad=20, min_words=0),
    Rule("word length", lambda c: abs(_per("word_chars", "n_words")(c) - 5.5), good=3, bad=6),
    Rule("symbols", _per("n_symbols", "n_words"), good=0.05, bad=0.3),
    Rule("repeated windows", _per("n_repeat_words", "n_words"), good=0.25, bad=0.5),
    Rule("repeated lines", _per("n_dup_lines", "n_lines"), good=0.15, bad=0.4),
    Rule("capitals", _per("n_upper", "word_chars"), good=0.1, bad=0.3),
    Rule("shouting", _per("n_shouts", "n_words"), good=0.05, bad=0.3),
    Rule("digits", _per("n_digits", "word_chars"), good=0.1, bad=0.3),
    Rule("function words", _per("n_function", "n_words"), good=0.12, bad=0.03, min_words=20),
    Rule("vocabulary", _per("n_distinct", "n_words"), good=0.3, bad=0.1, min_words=50),
)


def _counted(texts: pa.Array) -> dict[str, np.ndarray]:
    rows = np.array([count_text(t.as_py()) for t in texts], dtype=np.int64)
    return dict(zip(COUNTS, rows.reshape(-1, len(COUNTS)).T, strict=True))


def _votes(c: Counts, rules: Sequence[Rule]) -> np.ndarray:
    return np.stack([rule.vote(c) for rule in rules], axis=1)


@dataclass(frozen=True)
class Model:
    """What expectation-maximisation found.

    Class 0 is good; class 1 + j gathers texts that are bad in the way rule j looks
    for. ``share`` has each class's share of the documents and ``says_good[k][j]`` how
    often rule j, if it votes on a document of class k, votes good: its accuracy on
    good documents in row 0, one minus its accuracy on bad ones below.
    """

    share: tuple[float, ...]
    says_good: tuple[tuple[float, ...], ...]

    def probability(self, votes: np.ndarray) -> np.ndarray:
        """Posterior probability of class 0 for each row of votes."""
        return _posterior(votes, np.array(self.share), np.array(self.says_good))[:, 0]


def _posterior(votes: np.ndarray, share: np.ndarray, says_good: np.ndarray) -> np.ndarray:
    good, bad = (votes > 0).astype(float), (votes < 0).astype(float)
    logit = np.log(share) + good @ np.log(says_good).T + bad @ np.log(1 - says_good).T
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 500) -> Model:
    """Expectation-maximisation over vote combinations (rows) and their numbers.

    Texts are bad in one way or another, and most rules rightly see nothing wrong
    with them; with a single class for all bad texts, a frequent flaw would pass for
    a property of good ones. So there is one class per rule. To start with, nine in
    ten documents are good, rules are right on 97 % of them, and in its own class a
    rule votes bad nine times in ten. Abstaining says nothing. A few imagined votes
    at the starting figures keep everything off 0 and 1 and stand in without votes.
    """
    votes, weight = np.asarray(votes, float), np.asarray(weight, float)
    good, bad = (votes > 0).astype(float), (votes < 0).astype(float)
    rules = votes.shape[1]
    start_good = np.full((rules + 1, rules), 0.9)
    start_good[0] = 0.97
    start_good[1 + np.arange(rules), np.arange(rules)] = 0.1
    start_share = np.r_[0.9, np.full(rules, 0.1 / rules)]
    says_good, share = start_good, start_share
    for _ in range(rounds):
        p = _posterior(votes, share, says_good) * weight[:, None]
        new_good = (p.T @ good + 10 * start_good) / (p.T @ (good + bad) + 10)
        new_share = (p.sum(axis=0) + 10 * start_share) / (weight.sum() + 10)
        moved = np.abs(new_share - share).max() + np.abs(new_good - says_good).max()
        says_good, share = new_good, new_share
        if moved < 1e-9:
            break
    return Model(tuple(map(float, share)), tuple(tuple(map(float, row)) for row in says_good))


def fit(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> Model:
    """Estimate the model from all documents; only vote combinations reach the driver."""
    rules = tuple(rules)

    @F.arrow_udf("binary")
    def cast(texts: pa.Array) -> pa.Array:
        found = pa.array([v.tobytes() for v in _votes(_counted(texts), rules)], pa.binary())
        tidy()
        return found

    # at most 3 ** len(rules) rows
    found = docs.select(cast(col(text_col)).alias("votes")).groupBy("votes").count().collect()
    found.sort(key=lambda row: bytes(row["votes"]))  # a fixed order of the sums
    votes = np.array([np.frombuffer(row["votes"], np.int8) for row in found])
    return estimate(votes.reshape(-1, len(rules)), np.array([row["count"] for row in found]))


def score(
    docs: DataFrame,
    text_col: str = "text",
    threshold: float = 0.5,
    rules: Sequence[Rule] = RULES,
    model: Model | None = None,
    alias: str = "quality",
) -> DataFrame:
    """Add a struct with the counts, the votes, the probability and the verdict.

    ``base_failed`` holds for texts under 50 words and for texts over half of whose
    words lie in repeated three-word windows; such texts are never kept. All other
    texts are kept if ``probability`` reaches ``threshold``. A null or empty text has
    no words, so it fails. Ids play no part: null ids and repeated rows are judged
    each on their own. An empty table gives an empty table. A column of ``docs``
    named like ``alias`` is replaced, all others stay.
    """
    rules = tuple(rules)
    model = model or fit(docs, text_col, rules)
    fields = ",".join(f"{name}:bigint" for name in COUNTS)
    verdict = "votes:array<tinyint>,probability:double,base_failed:boolean,kept:boolean"

    @F.arrow_udf(f"struct<{fields},{verdict}>")
    def judge(texts: pa.Array) -> pa.Array:
        c = _counted(texts)
        votes = _votes(c, rules)
        probability = model.probability(votes)
        failed = (c["n_words"] < MIN_WORDS) | (
            100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"]
        )
        columns = {name: pa.array(c[name]) for name in COUNTS} | {
            "votes": pa.array(list(votes), pa.list_(pa.int8())),
            "probability": pa.array(probability),
            "base_failed": pa.array(failed),
            "kept": pa.array(~failed & (probability >= threshold)),
        }
        tidy()
        return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    return docs.withColumn(alias, judge(col(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that :func:`score` keeps, with their own columns only."""
    name = fresh(docs, "quality")
    scored = score(docs, text_col, threshold, alias=name)
    return scored.where(F.col(f"{name}.kept")).drop(name)
