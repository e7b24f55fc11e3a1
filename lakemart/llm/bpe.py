"""Byte-pair encoding of texts of any length, and decoding.

Short texts are encoded whole. Long ones are halved until the halves are short, the
halves are encoded all over the cluster, and the codes of neighbours are put together
up a tree. Where two parts meet their codes may be wrong, since neither saw the other
side. So a window around the join is encoded anew and grows until it agrees with what
lies on both sides: a few tokens in a row, at the same places, beyond the reach of what
the split rule can look ahead. Two codings that share a token go on alike on either
side of it (merges only depend on pairs of neighbours, the split rule on what follows),
so from there on the parts' own codes hold. A window that never agrees ends up as the
whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakemart.llm.common import by_value, col, fresh, kept_in_worker, tidy_after, with_computed
from lakemart.llm.packing import byte_letters, is_plain

by_value(__name__)

VOCABULARY = "byte_bpe_50k.json"
LEAF_CHARS = 32_768
# Tokens that must agree in a row, and bytes at a cut within which nothing counts as
# agreement: more than a contraction or a special token reaches.
AGREED = 4
UNSURE_BYTES = 32
FIRST_WINDOW = 64


class ByteTokenizer:
    """Ids as the tokenizers library gives them.

    Plain texts go to tiktoken, which has the same merges and is several times faster;
    all others to the library itself.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        rules = json.loads(Path(path).read_text())
        letters = byte_letters()
        vocabulary = rules["model"]["vocab"]
        special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): n for token, n in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, n in [*ranks.items(), *((t.encode(), n) for t, n in special.items())]:
            self.bytes[n] = token
        self.sizes = np.array([len(b) for b in self.bytes])
        self.slow: Tokenizer | None = None

    def ids(self, text: str) -> np.ndarray:
        if is_plain(text):
            return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def text(self, ids: np.ndarray) -> str:
        """Decoded text; bytes that are not UTF-8 become replacement characters."""
        known = ids[ids < len(self.bytes)].tolist()
        return b"".join(map(self.bytes.__getitem__, known)).decode("utf-8", "replace")


def tokenizer_of(path: str) -> ByteTokenizer:
    return kept_in_worker((VOCABULARY, path), lambda: ByteTokenizer(path))


def halves(length: int, leaf: int) -> list[tuple[int, int]]:
    """Ranges of the leaves from halving ``length`` until it is ``leaf`` or less."""
    if length <= leaf:
        return [(0, length)]
    middle = length // 2
    right = [(a + middle, b + middle) for a, b in halves(length - middle, leaf)]
    return halves(middle, leaf) + right


def _inside(data: bytes, at: int) -> bool:
    """Whether a place lies within a character."""
    return 0 < at < len(data) and data[at] & 0xC0 == 0x80


def agreement(
    ours: np.ndarray, ours_at: np.ndarray, theirs: np.ndarray, theirs_at: np.ndarray, low: int, high: int
) -> tuple[int, int] | None:
    """Where both codings have :data:`AGREED` equal tokens in a row within [low, high).

    Returns how many tokens come before that, in either coding. ``_at`` has the places
    of the tokens and the end of the last one.
    """
    common, i, j = np.intersect1d(ours_at[:-1], theirs_at[:-1], assume_unique=True, return_indices=True)
    same = (ours[i] == theirs[j]) & (common >= low) & (ours_at[i + 1] <= high)
    row = 0
    for n in range(len(common)):
        follows = n > 0 and i[n] == i[n - 1] + 1 and j[n] == j[n - 1] + 1
        row = (row + 1 if follows else 1) if same[n] else 0
        if row == AGREED:
            return int(i[n]) - AGREED + 1, int(j[n]) - AGREED + 1
    return None


def joined(left: np.ndarray, left_data: bytes, right: np.ndarray, right_data: bytes, tok: ByteTokenizer) -> np.ndarray:
    """The coding of two parts together, from the codings of both."""
    cut = len(left_data)
    left_at = np.r_[0, np.cumsum(tok.sizes[left])]
    right_at = cut + np.r_[0, np.cumsum(tok.sizes[right])]
    size = FIRST_WINDOW
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        while _inside(left_data, int(left_at[a])):
            a -= 1
        while _inside(right_data, int(right_at[b]) - cut):
            b += 1
        start, end = int(left_at[a]), int(right_at[b])
        window = tok.ids((left_data[start:] + right_data[: end - cut]).decode("utf-8", "surrogatepass"))
        at = start + np.r_[0, np.cumsum(tok.sizes[window])]
        before = (a, 0) if a == 0 else None
        after = (b, len(window)) if b == len(right) else None
        if before is None:
            found = agreement(left[a:], left_at[a:], window, at, start + UNSURE_BYTES, cut - UNSURE_BYTES)
            before = found and (a + found[0], found[1])
        if after is None:
            after = agreement(right[:b], right_at[: b + 1], window, at, cut + UNSURE_BYTES, end - UNSURE_BYTES)
        if before is not None and after is not None:
            return np.concatenate([left[: before[0]], window[before[1] : after[1]], right[after[0] :]])
        size *= 2


def joined_all(parts: list[tuple[np.ndarray, bytes]], tok: ByteTokenizer) -> np.ndarray:
    """Put neighbours together, pair by pair, up the tree."""
    while len(parts) > 1:
        pairs = [
            (joined(*parts[i], *parts[i + 1], tok), parts[i][1] + parts[i + 1][1])
            for i in range(0, len(parts) - 1, 2)
        ]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0][0]


def encode(
    docs: DataFrame,
    text_col: str = "text",
    alias: str = "ids",
    vocabulary: str | None = None,
    leaf: int = LEAF_CHARS,
) -> DataFrame:
    """Add the token ids of each text as packed little-endian unsigned 32-bit numbers.

    The same ids as the tokenizers library's for the whole text without adding special
    tokens; special tokens in a text count as such. A null or empty text has no ids
    (an empty value). Equal long texts are encoded once. Rows are independent of each
    other and of any id; an empty table gives an empty table. All columns stay; one
    named like ``alias`` is replaced.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    if alias in docs.columns and alias != text_col:
        docs = docs.drop(alias)
    text = col(text_col)
    digest = fresh(docs, "digest")
    is_long = F.coalesce(F.char_length(text), F.lit(0)) > leaf

    def encoder():
        tok = tokenizer_of(vocabulary)
        return lambda t: tok.ids(t or "").tobytes()

    short = with_computed(docs.where(~is_long), text_col, alias, pa.binary(), encoder)
    long = docs.where(is_long).withColumn(digest, F.sha2(text, 256))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, whole in zip(batch.column(0), batch.column(1), strict=True):
                value = whole.as_py()
                ranges = halves(len(value), leaf)
                columns = [
                    pa.array([key.as_py()] * len(ranges)),
                    pa.array(range(len(ranges)), pa.int32()),
                    pa.array([value[a:b] for a, b in ranges]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "part", "text"])

    def put_together(parts: pd.DataFrame) -> pd.DataFrame:
        tok = tokenizer_of(vocabulary)
        parts = parts.sort_values("part")
        coded = [
            (np.frombuffer(ids, "<u4"), t.encode("utf-8", "surrogatepass"))
            for ids, t in zip(parts["ids"], parts["text"], strict=True)
        ]
        return pd.DataFrame({"digest": parts["digest"].iloc[:1], "ids": [joined_all(coded, tok).tobytes()]})

    texts = long.groupBy(digest).agg(F.min(text).alias("text"))
    parts = texts.mapInArrow(tidy_after(split), "digest string, part int, text string").repartition("digest", "part")
    coded = with_computed(parts, "text", "ids", pa.binary(), encoder)
    whole = coded.groupBy("digest").applyInPandas(put_together, "digest string, ids binary")
    whole = whole.select(F.col("digest").alias(digest), F.col("ids").alias(alias))
    return short.unionByName(long.join(whole, digest).drop(digest).select(*short.columns))


def decode(coded: DataFrame, ids_col: str = "ids", alias: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add the text of packed ids, special tokens included; null for null."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def decoder():
        tok = tokenizer_of(vocabulary)
        return lambda packed: None if packed is None else tok.text(np.frombuffer(packed, "<u4"))

    return with_computed(coded, ids_col, alias, pa.string(), decoder)
