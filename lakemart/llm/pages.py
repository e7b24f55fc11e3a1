"""Main text of web pages by a linear-chain conditional random field.

A page is read into its leaf blocks: stretches of text between the borders of block
elements, each with its ancestors' tags and class names and some figures about its text.
The field labels the sequence of blocks as article or not: a weight for every feature of
a block and for every pair of neighbouring labels, the best sequence found by Viterbi.

It is trained on pages whose markup names the parts itself (:func:`labelled`): blocks
inside an article element are text, blocks in navigation, notices, forms and the like
are not. Where no page does, the texts say it themselves (:func:`dense`): the longest row
of sentences outside of what is named a menu, a notice or the like. So that the field doesn't lean on one way of writing pages, each training page
is also laid out anew under other element and class names, with menus, side bars,
notices, adverts, forms and reader comments around and inside the article.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, col, with_computed

by_value(__name__)

# Pages the field is trained on, the longest of them, and layouts made of each.
TRAINING_PAGES = 200
TRAINING_CHARS = 50_000
LAYOUTS = 4
STEPS = 150
RATE = 0.1
PENALTY = 1e-4

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")

# Element names of the HTML standard by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p "
    "pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head noscript template select datalist svg math object canvas button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "head", "html", "body"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass
class Block:
    """A stretch of text with the names above it."""

    text: str
    names: frozenset[str]
    tag: str
    linked: int


class _Reader:
    """Reads markup into leaf blocks in one pass; tags left open are closed as browsers do."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.above: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag = next((t for t, _ in reversed(self.stack) if t in BLOCKS), "")
                names = frozenset(n for n, count in self.above.items() if count > 0)
                self.blocks.append(Block(text, names, tag, self.linked))
            self.parts, self.linked = [], 0

    def open(self, tag: str, rest: str) -> None:
        if tag in CLOSES_P:
            self.close_within({"p"}, {"article", "section", "div", "body", "td", "li", "table"})
        if tag in CLOSES:
            self.close_within(*CLOSES[tag])
        names = [f"<{tag}>"]
        if "=" in rest:
            values = (a or b or c for a, b, c in NAMES.findall(rest))
            names += [f".{part}" for v in values for part in NAME_PARTS.findall(v.lower())]
        self.stack.append((tag, tuple(names)))
        self.above.update(names)

    def close_within(self, tags: set[str], stop: set[str]) -> None:
        """Close the innermost of some elements, unless another one is in between."""
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in tags:
                self.pop_to(at)
                return
            if tag in stop:
                return

    def close(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.pop_to(at)
                return

    def pop_to(self, at: int) -> None:
        for _, names in self.stack[at:]:
            for name in names:
                self.above[name] -= 1
                if not self.above[name]:
                    del self.above[name]
        del self.stack[at:]

    def text(self, data: str) -> None:
        if not any(f"<{tag}>" in self.above for tag in UNSEEN):
            found = html.unescape(data) if "&" in data else data
            self.parts.append(found)
            if "<a>" in self.above:
                self.linked += len(found.strip())


def read_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page; scripts, styles, comments and the head have none."""
    reader, at, page = _Reader(), 0, page or ""
    while True:
        found = MARKUP.search(page, at)
        if found is None:
            break
        if found.start() > at:
            reader.text(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        block = tag in BLOCKS
        if block:
            reader.flush()
        elif tag == "br":
            reader.parts.append(" ")
        if found[1]:
            reader.close(tag)
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not found[3].endswith("/"):
            reader.open(tag, found[3])
    reader.text(page[at:])
    reader.flush()
    return reader.blocks


# --- features ----------------------------------------------------------------


def _step(value: float, bounds: Sequence[float]) -> int:
    return sum(value >= b for b in bounds)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block: ancestors, own tag, figures of the text."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        size = len(b.text)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        out.append(
            [
                *b.names,
                f"tag={b.tag}",
                f"words={_step(words, (2, 4, 8, 15, 30, 60))}",
                f"linked={_step(b.linked / size, (0.01, 0.3, 0.7))}",
                f"marks={_step(marks / words, (0.01, 0.05, 0.15))}",
                f"ends={b.text[-1] in '.!?…'}",
                f"sign={'©' in b.text}",
                f"first={i == 0}",
                f"last={i == len(blocks) - 1}",
            ]
        )
    return out


# --- the field ---------------------------------------------------------------


@dataclass
class Field:
    """Weights for the label *article* by feature, and for pairs of labels in a row."""

    weights: dict[str, float]
    pairs: np.ndarray
    start: np.ndarray

    def label(self, blocks: list[Block]) -> list[bool]:
        """The likeliest sequence of labels, by Viterbi."""
        if not blocks:
            return []
        get = self.weights.get
        emitted = [sum([get(name, 0.0) for name in names]) for names in features(blocks)]
        (oo, oa), (ao, aa) = self.pairs.tolist()
        other, article = float(self.start[0]), float(self.start[1]) + emitted[0]
        back: list[tuple[bool, bool]] = []
        for e in emitted[1:]:
            from_article = (other + oo < article + ao, other + oa < article + aa)
            other, article = max(other + oo, article + ao), max(other + oa, article + aa) + e
            back.append(from_article)
        labels = [bool(article > other)]
        for from_article in reversed(back):
            labels.append(from_article[labels[-1]])
        return labels[::-1]


def train(pages: Iterable[tuple[list[Block], list[bool]]], steps: int = STEPS) -> Field:
    """Maximise the likelihood of the labels by gradient steps, all sequences side by side.

    The gradient is what the labels show less what the field expects, by the forward
    and backward sums.
    """
    pages = [(features(blocks), labels) for blocks, labels in pages if blocks]
    if not pages:
        return Field({}, np.zeros((2, 2)), np.zeros(2))
    names = sorted({name for page, _ in pages for block in page for name in block})
    number = {name: i for i, name in enumerate(names)}
    n, longest = len(pages), max(len(labels) for _, labels in pages)
    truth = np.zeros((n, longest), int)
    length = np.array([len(labels) for _, labels in pages])
    at, which = [], []
    for p, (page, labels) in enumerate(pages):
        truth[p, : len(labels)] = labels
        for t, block in enumerate(page):
            at += [p * longest + t] * len(block)
            which += [number[name] for name in block]
    at, which = np.array(at), np.array(which)
    inside = np.arange(longest) < length[:, None]
    paired = inside[:, 1:]
    shown = np.bincount(which, truth.ravel()[at].astype(float), len(names))
    shown_pairs = np.zeros((2, 2))
    np.add.at(shown_pairs, (truth[:, :-1][paired], truth[:, 1:][paired]), 1)
    shown_start = np.bincount(truth[:, 0], minlength=2).astype(float)
    flat = np.zeros(len(names) + 6)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        w, pairs, start = flat[: len(names)], flat[len(names) : -2].reshape(2, 2), flat[-2:]
        emitted = np.zeros((n, longest, 2))
        emitted[:, :, 1] = np.bincount(at, w[which], n * longest).reshape(n, longest)
        forward = np.empty((n, longest, 2))
        forward[:, 0] = start + emitted[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1) + emitted[:, t]
            forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(pairs + (emitted[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(inside[:, t + 1, None], new, 0)
        label = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
        both = forward[:, :-1, :, None] + pairs + (emitted + backward)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.bincount(which, label[:, :, 1].ravel()[at], len(names))
        expected_pairs = (np.exp(both) * paired[:, :, None, None]).sum(axis=(0, 1))
        gradient = np.concatenate(
            [shown - expected, (shown_pairs - expected_pairs).ravel(), shown_start - label[:, 0].sum(axis=0)]
        )
        gradient = gradient / n - PENALTY * flat
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        flat = flat + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = dict(zip(names, map(float, flat[: len(names)]), strict=True))
    return Field(weights, flat[len(names) : -2].reshape(2, 2), flat[-2:])


# --- training pages ----------------------------------------------------------

ARTICLE = frozenset(("<article>", "<main>"))
NOT_ARTICLE = frozenset(
    [f"<{tag}>" for tag in "nav header footer aside form fieldset dialog menu".split()]
    + [
        f".{name}"
        for name in "ad ads advert banner comment comments cookie menu nav newsletter notice promo related sidebar sponsored".split()
    ]
)


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks and labels of a page that names its parts itself."""
    blocks = read_blocks(page)
    return blocks, [bool(b.names & ARTICLE) and not b.names & NOT_ARTICLE for b in blocks]


SENTENCE_WORDS = 8
SENTENCE = re.compile(r"[.!?…][\"'”’)]*$")
# Blocks without a sentence that may stand between those of an article: headings, short lines.
GAP_BLOCKS = 2


def dense(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks and labels of a page without named parts: its longest row of sentences.

    A heading right before the row belongs to it. Without any sentence nothing is labelled.
    """
    blocks = read_blocks(page)
    said = [
        len(b.text.split()) >= SENTENCE_WORDS and bool(SENTENCE.search(b.text)) and not b.names & NOT_ARTICLE
        for b in blocks
    ]
    best, size, first, last, here = (0, 0), 0, 0, -GAP_BLOCKS - 2, 0
    for i in [i for i, y in enumerate(said) if y]:
        if i - last > GAP_BLOCKS + 1:
            first, here = i, 0
        here += len(blocks[i].text)
        last = i
        if here > size:
            best, size = (first, i + 1), here
    begin, end = best
    if size and begin and blocks[begin - 1].tag in ("h1", "h2") and not blocks[begin - 1].names & NOT_ARTICLE:
        begin -= 1
    return blocks, [begin <= i < end and not b.names & NOT_ARTICLE for i, b in enumerate(blocks)]


# Ways of writing the parts of a page: what opens and closes them.
AROUND_ARTICLE = (
    "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="main-content">',
    '<div class="post-body">', '<section class="story">', '<div class="entry">', '<div role="main">',
    '<article class="post"><div class="text">', "<div>", "<section>", '<section id="content">', '<div id="page"><section class="main">', '<td class="body">',
)
MENUS = ("<nav><ul>", '<div class="menu"><ul>', '<ul class="navigation">', '<div id="topnav">', '<header><nav>', "<header><ul>")
BESIDE = (
    "<aside>", '<div class="sidebar">', '<div class="ad">', '<div class="advert">', '<div class="cookie-notice">',
    '<section class="related">', "<form>", '<div class="newsletter"><form>', '<div class="promo">', '<div class="banner">',
    '<aside class="share">', '<div role="dialog" class="consent">', '<div class="sponsored">', "<header>", '<div class="popup notice">',
    '<div class="breadcrumbs">', '<div class="widget">', '<div class="alert">',
)
COMMENTS = (
    '<section class="comments">', '<div id="comments"><div class="comment">', '<ol class="comment-list">', '<div class="replies">',
    '<div class="discussion">', '<section id="reader-comments"><article class="comment">', '<div class="user-comments">',
)
FOOTERS = ("<footer>", '<div class="footer">', '<div id="page-footer">', '<footer class="site">')
OPENED = re.compile(r"<(\w+)")


def _wrap(opening: str, inner: str) -> str:
    return opening + inner + "".join(f"</{tag}>" for tag in reversed(OPENED.findall(opening)))


def layout(
    article: list[Block], others: list[str], strangers: list[str], rng: random.Random
) -> tuple[list[Block], list[bool]]:
    """The page's texts under other names; labels follow from where each text was put."""
    mark = "\ue000"  # of a private area: in no text

    def said(text: str, is_article: bool) -> str:
        return html.escape(text) + (mark if is_article else "")

    def some(texts: list[str], most: int) -> list[str]:
        return rng.sample(texts, min(len(texts), rng.randint(1, most))) if texts else []

    def menu() -> str:
        tag = rng.choice(("li", "div", "span"))
        return "".join(f'<{tag}><a href="#">{said(t, False)}</a></{tag}> ' for t in some(others, 8))

    def beside() -> str:
        texts = [f"<p>{said(t, False)}</p>" for t in some(others + strangers, 2)]
        if rng.random() < 0.3:
            texts.insert(0, f"<h3>{said(' '.join(rng.choice(strangers).split()[:4]), False)}</h3>")
        return _wrap(rng.choice(BESIDE), "".join(texts))

    parts = []
    for b in article:
        tag = b.tag if b.tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre") else "p"
        if tag == "h1":
            tag = rng.choice(("h1", "h1", "h2"))
        elif rng.random() < 0.06:
            sub = rng.choice(("h2", "h3", "h4"))
            parts.append(f"<{sub}>{said(' '.join(b.text.split()[:6]), True)}</{sub}>")
        if tag == "p" and rng.random() < 0.12:  # as a list or a table
            row, cell = rng.choice((("ul", "li"), ("ol", "li"), ("table", "td"), ("dl", "dd")))
            cells = [x for x in re.split(r"(?<=[.!?]) ", b.text) if x][:6]
            parts.append(f"<{row}>" + "".join(f"<{cell}>{said(x, True)}</{cell}>" for x in cells) + f"</{row}>")
        else:
            parts.append(f"<{tag}>{said(b.text, True)}</{tag}>")
        if rng.random() < 0.06:
            parts.append(beside())
    body = [_wrap(rng.choice(MENUS), menu())] if rng.random() < 0.9 else []
    body += [beside() for _ in range(rng.choice((0, 1, 2)))]
    body.append(_wrap(rng.choice(AROUND_ARTICLE), "".join(parts)))
    body += [beside() for _ in range(rng.choice((0, 0, 1, 2)))]
    if rng.random() < 0.6:
        remarks = "".join(f"<{t}>{said(x, False)}</{t}>" for x in some(strangers, 4) for t in [rng.choice(("p", "div", "li"))])
        body.append(_wrap(rng.choice(COMMENTS), remarks))
    if rng.random() < 0.9:
        body.append(_wrap(rng.choice(FOOTERS), f"<p>&copy; {''.join(said(t, False) for t in some(others, 1))}</p>"))
    blocks = read_blocks("<body>" + "".join(body) + "</body>")
    labels = [mark in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace(mark, "")
    kept = [(b, y) for b, y in zip(blocks, labels, strict=True) if b.text]
    return [b for b, _ in kept], [y for _, y in kept]


def training_set(pages: list[str], layouts: int = LAYOUTS, seed: int = 0) -> Iterator[tuple[list[Block], list[bool]]]:
    """Pages as they are, and laid out anew some times each."""
    rng = random.Random(seed)
    known = [labelled(page) for page in pages]
    if not any(any(labels) for _, labels in known):
        known = [dense(page) for page in pages]
    known = [(blocks, labels) for blocks, labels in known if any(labels)]
    texts = [b.text for blocks, labels in known for b, y in zip(blocks, labels, strict=True) if y]
    for blocks, labels in known:
        yield blocks, labels
        article = [b for b, y in zip(blocks, labels, strict=True) if y]
        others = [b.text for b, y in zip(blocks, labels, strict=True) if not y]
        for _ in range(layouts):
            yield layout(article, others, rng.sample(texts, min(6, len(texts))), rng)


def fit(pages: DataFrame, html_col: str = "html", most: int = TRAINING_PAGES) -> Field:
    """Train on ``most`` pages at most, those with the smallest hashes of their text.

    Only pages of 50,000 characters or less can be chosen, and only those that name their
    parts; if none does, all of them.
    """
    text = col(html_col)
    short = pages.select(text.alias("html")).where(F.char_length(text) <= TRAINING_CHARS)
    short = short.withColumn("hash", F.xxhash64("html"))

    def first(usable: DataFrame) -> list[int]:
        # narrow rows are sorted, and only the chosen pages reach the driver
        return [r["hash"] for r in usable.select("hash").distinct().orderBy("hash").limit(most).collect()]

    usable = short.where(F.lower("html").rlike("<(article|main)"))
    hashes = first(usable)
    if not hashes:
        usable = short
        hashes = first(usable)
    chosen = usable.where(F.col("hash").isin(hashes)).groupBy("hash").agg(F.min("html").alias("html"))
    found = sorted((r["hash"], r["html"]) for r in chosen.collect())
    return train(training_set([page for _, page in found]))


def main_text(page: str | None, field: Field) -> str:
    blocks = read_blocks(page)
    labels = field.label(blocks)
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, html_col: str = "html", alias: str = "text", field: Field | None = None) -> DataFrame:
    """Add the main text of each page, its blocks in page order joined by line ends.

    Character references are decoded and white space within a block is one space. A
    null or empty page, and one without an article, has an empty text. Pages are
    independent of each other and of any id, so null ids and repeated rows don't
    matter. Pages may have any length; those too long to train on are read to their end.
    An empty table gives an empty table. A table without pages that name their parts is
    trained on its own rows of sentences; without any of these nothing is known and all
    texts are empty. All columns stay; one named like ``alias`` is replaced.
    """
    field = field or fit(pages, html_col)
    return with_computed(pages, html_col, alias, pa.string(), lambda: lambda page: main_text(page, field))
