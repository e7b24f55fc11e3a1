"""Language identification: known words first, shorter and shorter n-grams for the rest.

The model counts, over all labelled documents, how often each word occurs in each
language. A text is scored word by word: a known word by the logarithm of its frequency
in each language, an unseen one by its character n-grams, at each place the longest
known one of four characters down to one. The language with the largest sum wins.

Every word counted is a known one, however long. Tasks hold the most frequent of them,
at most ``vocabulary``; the texts' other words are made distinct, joined to the table of
all words, scored once each (those in no table by their n-grams) and their scores summed
up per text, all of it in Spark. Of n-grams each language has its ``grams`` most frequent
of each length; equally frequent ones go by their letters. Counting covers every labelled
document.

Scores are whole numbers, multiples of 1 / :data:`UNIT`, so that sums do not depend on
the order of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, col, fresh, tidy, tidy_after, written

by_value(__name__)

VOCABULARY = 250_000
GRAMS = 20_000
LONGEST_GRAM = 4
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}+")
# Longer words are not held by tasks; like all that are not, they are looked up in the table.
LONGEST_HELD = 60
COUNTED_AT_ONCE = 300_000
# Letters of a word whose n-grams are cut at once.
LETTERS_AT_ONCE = 100_000
SMOOTHING = 0.5
REMEMBERED = 200_000
UNIT = 1 << 26
# Latin-1 without all but small letters: what is left are the words.
SMALL_LETTERS = bytes(
    ord(chr(b).lower()) if regex.fullmatch(r"\p{L}", chr(b)) else 0x20 for b in range(256)
)


def words_of(text: str) -> list[str]:
    """Runs of letters, in small letters."""
    try:
        return text.encode("latin-1").translate(SMALL_LETTERS).decode("latin-1").split(" ")
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def grams_of(word: str, length: int) -> list[str]:
    """All n-grams of a word with its borders marked; a border alone is none."""
    marked = f" {word} "
    border = int(length == 1)
    return [marked[i : i + length] for i in range(border, len(marked) - length + 1 - border)]


def _counts(lang: list, text: list, count: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(text, pa.string()), pa.array(list(count.values()), pa.int64())],
        names=["lang", "text", "n"],
    )


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text, n) of all words; each task sums up before it sends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                found.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
                if sum(map(len, found.values())) > COUNTED_AT_ONCE:
                    for name, c in found.items():
                        yield _counts([name] * len(c), list(c), c)
                    found = {}
        for name, c in found.items():
            yield _counts([name] * len(c), list(c), c)

    labelled = docs.select(col(lang_col).alias("lang"), col(text_col).alias("text")).dropna()
    counts = labelled.mapInArrow(tidy_after(count), "lang string, text string, n bigint")
    # between two other characters there is an empty word, which is none
    return counts.where("text != ''").groupBy("lang", "text").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int = LONGEST_GRAM) -> DataFrame:
    """(lang, text, n) of the n-grams of counted words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[str, int]] = {}
        size = 0
        for batch in batches:
            for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = found.setdefault(lang, {})
                get, before = own.get, len(own)
                for length in range(1, longest + 1):
                    for begin in range(0, len(word), LETTERS_AT_ONCE):
                        # a part with the letters behind it that its last n-grams reach into
                        part = word[max(0, begin - length + 1) : begin + LETTERS_AT_ONCE]
                        if len(part) == len(word):
                            grams = grams_of(word, length)
                        else:
                            grams = _inner(word, length, begin)
                        for gram in grams:
                            own[gram] = get(gram, 0) + n
                size += len(own) - before
                if size > COUNTED_AT_ONCE:
                    for name, c in found.items():
                        yield _counts([name] * len(c), list(c), c)
                    found, size = {}, 0
        for name, c in found.items():
            yield _counts([name] * len(c), list(c), c)

    counts = words.mapInArrow(tidy_after(count), "lang string, text string, n bigint")
    return counts.groupBy("lang", "text").agg(F.sum("n").alias("n"))


def _inner(word: str, length: int, begin: int) -> Iterator[str]:
    """The n-grams of a long word that start in the part at ``begin``, borders included."""
    end = min(begin + LETTERS_AT_ONCE, len(word))
    if begin == 0 and length > 1:
        yield f" {word[: length - 1]}"
    for i in range(begin, end):
        gram = word[i : i + length]
        if len(gram) == length:
            yield gram
        elif i + length - 1 == len(word):
            yield f"{gram} "


def _gathered(found: DataFrame, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The texts of (text, lang, n) rows and their counts per language."""
    table = found.select("text", "lang", "n").toArrow()
    texts = sorted(set(table["text"].to_pylist()))
    row = {t: i for i, t in enumerate(texts)}
    column = {name: i for i, name in enumerate(languages)}
    n = np.zeros((len(texts), len(languages)))
    at = [row[t] for t in table["text"].to_pylist()], [column[x] for x in table["lang"].to_pylist()]
    n[at] = table["n"].to_numpy()
    return texts, n


def frequent(counts: DataFrame, most: int, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The texts as frequent as a threshold allows, and their counts per language.

    The threshold is a power of 2 ** 0.125, set from the numbers of texts between such
    powers, so that at most ``most`` texts remain.
    """
    pair = F.struct("lang", "n")
    whole = counts.groupBy("text").agg(F.sum("n").alias("total"), F.collect_list(pair).alias("langs"))
    graded = whole.withColumn("grade", F.floor(8 * F.log2("total")))
    # a few hundred rows, however many texts
    left, least = most, None
    for r in sorted(graded.groupBy("grade").count().collect(), key=lambda r: -r["grade"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["grade"]
    keep = F.lit(False) if least is None else F.col("grade") >= least
    found = graded.where(keep).select("text", F.explode("langs").alias("l")).select("text", "l.lang", "l.n")
    return _gathered(found, languages)


def frequent_grams(counts: DataFrame, most: int, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The ``most`` most frequent n-grams of each length in each language, and their counts in all."""
    length = F.char_length("text")
    order = Window.partitionBy("lang", length).orderBy(F.desc("n"), "text")
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return _gathered(counts.join(first.select("text").distinct(), "text", "left_semi"), languages)


@dataclass
class Model:
    """Scores by word and n-gram, a row of :attr:`languages` each.

    If not all words are held, ``rest`` has the counts of all, (text, langs), for
    :func:`predict` to join; the method of a single text does without.
    """

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    # logarithms of the languages' smoothed totals
    word_totals: np.ndarray
    rest: DataFrame | None = None
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def unseen(self, word: str) -> np.ndarray:
        """Scores from n-grams, the longest known one at each place."""
        marked = f" {word} "
        total, rows, get = np.zeros(len(self.languages)), [], self.grams.get
        for i in range(len(marked) - 1):
            for end in range(i + LONGEST_GRAM, i, -1):
                at = get(marked[i:end])
                if at is not None:
                    rows.append(at)
                    break
            if len(rows) == LETTERS_AT_ONCE:
                total += self.gram_scores[rows].sum(axis=0)
                rows = []
        total += self.gram_scores[rows].sum(axis=0)
        # n-grams overlap, so each place counts as a share of a word
        return np.rint(total / LONGEST_GRAM * UNIT).astype(np.int64)

    def _remembered(self, word: str) -> np.ndarray:
        found = self.seen.get(word)
        if found is None:
            found = self.unseen(word)
            if len(word) <= LONGEST_HELD:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def held(self, text: str | None) -> tuple[np.ndarray | None, Counter]:
        """The sum over the words held, null for a text without any words, and the other words."""
        words = words_of(text) if text else []
        if not self.languages:
            return None, Counter()
        at = list(map(self.words.get, words))
        total, others = np.zeros(len(self.languages), np.int64), Counter()
        if None in at:
            others.update(w for w, i in zip(words, at, strict=True) if i is None and w)
            at = [i for i in at if i is not None]
        if at:
            total += self.word_scores[at].sum(axis=0)
        return (total, others) if at or others else (None, others)

    def best(self, total: np.ndarray | None) -> tuple[str, float]:
        if total is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp((total - total[best]) / UNIT).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        total, others = self.held(text)
        for word, k in others.items():
            total += k * self._remembered(word)
        return self.best(total)


def _scores(n: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies among the texts of a group."""
    n = n + SMOOTHING
    for group in np.unique(groups):
        at = groups == group
        n[at] = np.log(n[at] / n[at].sum(axis=0))
    return n


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: int = VOCABULARY,
    grams: int = GRAMS,
) -> Model:
    """Learn from every row of ``docs`` with a text and a language."""
    words = written(word_counts(docs, text_col, lang_col), "language-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    known, word_counts_ = frequent(words.where(F.char_length("text") <= LONGEST_HELD), vocabulary, languages)
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    distinct = words.select("text").distinct().count()
    word_totals = np.log(np.array([totals[name] for name in languages]) + SMOOTHING * distinct)
    rest = None
    if distinct > len(known):
        rest = words.groupBy("text").agg(F.collect_list(F.struct("lang", "n")).alias("langs"))
    pieces = written(gram_counts(words), "language-grams")
    pieces, gram_counts_ = frequent_grams(pieces, grams, languages)
    return Model(
        languages,
        {w: i for i, w in enumerate(known)},
        np.rint((np.log(word_counts_ + SMOOTHING) - word_totals) * UNIT).astype(np.int64),
        {g: i for i, g in enumerate(pieces)},
        _scores(gram_counts_, np.array([len(g) for g in pieces])),
        word_totals,
        rest,
    )


def predict(docs: DataFrame, model: Model, text_col: str = "text", alias: str = "language") -> DataFrame:
    """Add a struct (lang, score): the likeliest language and its share of all likelihoods.

    Null texts and texts without letters are ``und`` with score 0, and so are all texts
    if nothing was learned. Texts and words of any length are read to their end. Equal scores go to the language that sorts first. No other
    column is looked at, repeated rows get the same result, an empty table gives an
    empty table. All columns stay; one named like ``alias`` is replaced.
    """
    return _predicted(docs, model, text_col, alias, docs.columns)


def _predicted(docs: DataFrame, model: Model, text_col: str, alias: str, columns: list[str]) -> DataFrame:
    """Some columns of ``docs`` and the struct of :func:`predict`."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None, seen={}))
    kept = [col(c) for c in columns]

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        tidy()
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=["lang", "score"],
        )

    if model.rest is None:
        return docs.withColumn(alias, run(col(text_col))).select(*kept, *_new(alias, columns))

    @F.arrow_udf("struct<total:array<bigint>,words:array<string>,ks:array<bigint>>")
    def begin(texts: pa.Array) -> pa.Array:
        totals, words, ks, ends = [], [], [], [0]
        for text in texts:
            total, others = shared.value.held(text.as_py())
            totals.append(total)
            words += others.keys()
            ks += others.values()
            ends.append(len(words))
        tidy()
        at = pa.array(ends, pa.int32())
        return pa.StructArray.from_arrays(
            [
                pa.array(totals, pa.list_(pa.int64())),
                pa.ListArray.from_arrays(at, pa.array(words, pa.string())),
                pa.ListArray.from_arrays(at, pa.array(ks, pa.int64())),
            ],
            names=["total", "words", "ks"],
        )

    @F.arrow_udf("array<bigint>")
    def unseen(words: pa.Array) -> pa.Array:
        found = [shared.value.unseen(w.as_py()) for w in words]
        tidy()
        return pa.array(found, pa.list_(pa.int64()))

    row, part = fresh(docs, "row"), fresh(docs, "part")
    # row numbers stay as they are, since they are written
    begun = docs.select(*kept, F.monotonically_increasing_id().alias(row), begin(col(text_col)).alias(part))
    begun = written(begun, "language-begun")
    asked = begun.select(
        F.col(row).alias("row"), F.inline(F.arrays_zip(F.col(f"{part}.words"), F.col(f"{part}.ks"))).alias("word", "k")
    )
    # each word once, whatever the number of texts that have it
    found = asked.select("word").distinct().join(model.rest.withColumnRenamed("text", "word"), "word", "left")
    found = written(found, "language-asked")
    n = F.map_from_entries("langs")
    known = [
        F.rint((F.log(F.coalesce(n[name], F.lit(0)) + SMOOTHING) - float(total)) * UNIT).cast("bigint")
        for name, total in zip(model.languages, model.word_totals, strict=True)
    ]
    scored = found.where("langs is not null").select("word", F.array(*known).alias("s"))
    scored = scored.union(found.where("langs is null").select("word", unseen("word").alias("s")))
    sums = [F.sum(F.col("k") * F.col("s")[i]).alias(f"sum{i}") for i in range(len(model.languages))]
    answers = asked.join(scored, "word").groupBy("row").agg(*sums)
    total, best, held = fresh(docs, "total"), fresh(docs, "best"), F.col(f"{part}.total")
    answers = answers.select(F.col("row").alias(row), F.array(*[f"sum{i}" for i in range(len(sums))]).alias(total))

    joined = begun.join(answers, row, "left")
    both = F.zip_with(held, F.coalesce(F.col(total), F.transform(held, lambda _: F.lit(0).cast("bigint"))), lambda a, b: a + b)
    joined = joined.withColumn(total, both).withColumn(best, F.array_max(total))
    likely = F.aggregate(
        F.col(total), F.lit(0.0), lambda acc, x: acc + F.exp((x - F.col(best)).cast("double") / UNIT)
    )
    names = F.lit(model.languages)
    result = F.when(
        F.col(best).isNotNull(),
        F.struct(
            F.element_at(names, F.array_position(F.col(total), F.col(best)).cast("int")).alias("lang"),
            (1 / likely).alias("score"),
        ),
    ).otherwise(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))
    return joined.withColumn(alias, result).select(*kept, *_new(alias, columns))


def _new(alias: str, columns: list[str]) -> list[Column]:
    return [] if alias.lower() in {c.lower() for c in columns} else [col(alias)]


def held_out(id_: Column) -> Column:
    """A quarter of the ids; null is not among them."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Learn from the rows that are not held out and predict all: (doc_id, held_out, lang_pred, score).

    Rows with a null id, text or language are not learned from.
    """
    rows = docs.select(
        col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang")
    ).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.where("doc_id is not null and not held_out"))
    found = _predicted(rows, model, "text", "language", ["doc_id", "held_out"])
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
