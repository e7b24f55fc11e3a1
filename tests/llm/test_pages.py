"""Main text of pages: read from the markup, and on pages written in other ways."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest

from lakemart.llm import pages


@pytest.fixture(scope="module")
def field(spark, small_dir):
    return pages.fit(spark.read.parquet(small_dir.replace("sf0.001", "sf0.01") + "/pages.parquet"))


def from_markup(page):
    """What lies between the article's tags, cut at its headings and paragraphs."""
    inner = page.partition("<article>")[2].partition("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", inner)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark, small_dir, field):
    from __spark_entry__ import queries

    where = small_dir.replace("sf0.001", "sf0.01")
    source = {r["page_id"]: r for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    found = queries()["op1_html_extraction"](spark, where).collect()
    assert len(found) == len(source)
    for r in found:
        assert r["url"] == source[r["page_id"]]["url"]
        assert r["text"] == from_markup(source[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"])


TITLE = "A title for it"
BODY = [
    "This is the first paragraph of the story, and it has several clauses.",
    "A second paragraph follows, with more detail about the matter at hand.",
    "The third one closes the story.",
]
TEXT = "".join(f"<p>{p}</p>" for p in BODY)
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


@pytest.mark.parametrize(
    "page",
    [
        f"<header>Our site, a tag line.</header>{MENU}<main><h1>{TITLE}</h1>{TEXT}</main><footer>&copy; us</footer>",
        f'<div class="menu"><a href="/">Home</a></div><div class="content"><h1>{TITLE}</h1>{TEXT}</div>'
        '<div class="comments"><div class="comment"><p>I liked this story a lot, thanks for it.</p></div></div>',
        f'<article><h1>{TITLE}</h1>{TEXT}<aside><p>A side bar, quite long, with commas.</p></aside></article>',
        f'<article><h1>{TITLE}</h1>{TEXT}<form><p>Your name, please, enter it here.</p><input></form></article>',
        f'{MENU}<div class="cookie-notice"><p>We use cookies, as all do.</p></div><article><h1>{TITLE}</h1>{TEXT}</article>',
        f'<article><h1>{TITLE}</h1>{TEXT}</article><div class="sidebar"><p>Read this as well, it is good.</p></div>',
        f'<script>var a = "<p>no</p>";</script><style>p {{}}</style><article><h1>{TITLE}</h1>{TEXT}',
    ],
)
def test_other_ways_of_writing(field, page):
    found = pages.main_text(f"<html><head><title>x</title></head><body>{page}</body></html>", field)
    assert found == "\n".join([TITLE, *BODY])


def test_characters_and_white_space(field):
    page = f"<article><h1>{TITLE}</h1><p> a&lt;b &amp;amp; caf&eacute;&#33;\n\t x&nbsp;y<br>z, and so on. </p>{TEXT}</article>"
    assert pages.main_text(page, field).split("\n")[1] == "a<b &amp; café! x y z, and so on."


def test_blocks_of_loose_markup():
    page = "<p>one<p>two <b>bold<p>three<ul><li>x<li>y</ul><!-- <p>no</p> --><div>d</p>e<br/>f<hr>g"
    found = [(b.text, "<b>" in b.names) for b in pages.read_blocks(page)]
    assert [t for t, _ in found] == ["one", "two bold", "three", "x", "y", "d", "e f", "g"]
    assert [t for t, bold in found if bold] == ["two bold"]
    assert pages.read_blocks(None) == pages.read_blocks("") == pages.read_blocks("<script>x") == []
    assert [b.text for b in pages.read_blocks("a < b <i title='>'>c</i> &xyz;")] == ["a < b c &xyz;"]
    assert len(pages.read_blocks("<div>" * 3000 + "x" + "</div>" * 10)) == 1


def all_paths(field, blocks):
    weights = [sum(field.weights.get(n, 0.0) for n in names) for names in pages.features(blocks)]
    for path in itertools.product((0, 1), repeat=len(blocks)):
        score = field.start[path[0]] + sum(w for w, y in zip(weights, path, strict=True) if y)
        yield score + sum(field.pairs[a, b] for a, b in zip(path, path[1:], strict=False)), path


def test_viterbi_equals_trying_all_paths():
    rng = random.Random(6)
    for _ in range(30):
        blocks = [pages.Block("a b c, d." * rng.randint(1, 9), frozenset(rng.sample(["<p>", "<nav>", ".x"], 2)), "p", 0) for _ in range(6)]
        weights = {n: rng.gauss(0, 1) for names in pages.features(blocks) for n in names}
        pairs = np.array([[rng.gauss(0, 2) for _ in range(2)] for _ in range(2)])
        field = pages.Field(weights, pairs, np.array([rng.gauss(0, 1), rng.gauss(0, 1)]))
        scores = {path: score for score, path in all_paths(field, blocks)}  # equal ones happen
        assert scores[tuple(map(int, field.label(blocks)))] >= max(scores.values()) - 1e-9


def test_training_uses_neighbours():
    """A block without a telling feature takes the label of those around it."""
    blocks = lambda names: [pages.Block("same words", frozenset([n]), "p", 0) for n in names]
    pages_ = [(blocks(["<a>", "<x>", "<a>"]), [True] * 3), (blocks(["<n>", "<x>", "<n>"]), [False] * 3)] * 10
    field = pages.train(pages_)
    assert field.label(blocks(["<a>", "<x>", "<a>"])) == [True] * 3
    assert field.label(blocks(["<n>", "<x>", "<n>"])) == [False] * 3


def test_odd_rows(spark, field):
    rows = [(None, None, 1), (1, "", 1), (2, f"<article><h1>{TITLE}</h1>{TEXT}</article>", 2)] * 2
    docs = spark.createDataFrame(rows, "page_id int, html string, text int")
    found = pages.extract(docs, field=field)
    assert found.columns == ["page_id", "html", "text"]
    assert sorted(len(r["text"]) for r in found.collect())[:4] == [0] * 4
    assert pages.extract(docs.where("1 = 0")).collect() == []
    nothing = spark.createDataFrame([("<div>no part is named here</div>",)], "html string")
    assert [r["text"] for r in pages.extract(nothing).collect()] == [""]


def test_pages_without_named_parts(spark):
    """Layouts of div and table elements only: sentences are told by themselves."""
    rng = random.Random(3)
    nouns = "harbour engine letter garden winter market river painter signal window".split()

    def sentence():
        words = [rng.choice(nouns) if i % 2 else rng.choice(["the", "a", "near", "with", "under"]) for i in range(rng.randint(9, 16))]
        return " ".join(words).capitalize() + "."

    rows, wanted = [], {}
    for i in range(60):
        title, body = f"About the {rng.choice(nouns)} {i}", [f"{sentence()} {sentence()}" for _ in range(rng.randint(3, 6))]
        menu = "".join(f'<div><a href="#">{rng.choice(nouns)}</a></div>' for _ in range(5))
        text = f"<h1>{title}</h1>" + "".join(f"<div>{b}</div>" for b in body)
        page = f'<table><tr><td class="m{i}">{menu}</td><td class="b"><div>{text}</div></td></tr></table><div>Copyright {i}</div>'
        rows.append((i, f"<html><body>{page}</body></html>"))
        wanted[i] = "\n".join([title, *body])
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert sum(found[i] == wanted[i] for i in wanted) >= 57


def test_other_attributes_name_nothing():
    (block,) = pages.read_blocks('<div data-id="comments" class="story"><p>x</p></div>')
    assert ".story" in block.names and ".comments" not in block.names


def test_a_very_long_page(field):
    text = "".join(f"<p>Sentence number {i} of a long article goes on and on.</p>" for i in range(20_000))
    found = pages.main_text(f"<body>{MENU}<article><h1>{TITLE}</h1>{text}</article></body>", field)
    assert found.count("\n") == 20_000 and found.startswith(TITLE)
