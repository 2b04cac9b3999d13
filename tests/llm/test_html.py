import numpy as np
import pytest

from eddyline.llm import html_extract
from eddyline.llm.html_blocks import blocks
from eddyline.llm.html_training import MARK, labelled_pages
from tests.llm import helpers as H

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


def test_held_out_blocks(model):
    """Pages of another seed: blocks of the article are told from the rest."""
    right = total = exact = 0
    pages = labelled_pages(300, 77)
    for page in pages:
        found = blocks(page)
        gold = [int(b.text.startswith(MARK)) for b in found]
        got = model.decode([b._replace(text=b.text.removeprefix(MARK).strip() or "x") for b in found])
        right += sum(a == b for a, b in zip(gold, got, strict=True))
        total += len(gold)
        exact += gold == got
    assert right / total > 0.97 and exact / len(pages) > 0.8


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a  b\n c</p><p>d<br>e</p>", ["a b c", "d e"]),
    ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
    ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("a &amp; b &lt;p&gt; &#233; &eacute; &nbsp;c", ["a & b <p> é é c"]),
    ("<script>var t='</p>';x<y</script>t<style>p{}</style><!-- <p>no</p> -->u", ["tu"]),
    ("<head><title>no</title></head><body>yes", ["yes"]),
    ("<head><title>no</title><body>yes", ["yes"]),
    ("<div hidden>one</div><div style='display:none'>two<div>three</div></div>four", ["one", "two", "three", "four"]),
    ("<p hidden>a<p>b", ["a", "b"]),
    ("<noscript>a</noscript>b", ["a", "b"]),
    ("x<script>never ends", ["x"]),
    ("x<!-- never ends <b>", ["x"]),
    ("<p>a <script>no</script>b <math><mi>x</mi><mo>=</mo><mn>1</mn></math> c<svg><text>no</text></svg></p>", ["a b x=1 c"]),
    ("<select><option>no<option>no</select>a<select>b", ["ab"]),
    ("<svg>a<svg></svg>b</p>c", ["b", "c"]),
    ("a &#0000000000065; &#x000000041; &#99999999999; &#xFFFFFFFFF;", ["a A A \ufffd \ufffd"]),
    ("<a title='x>y' href=\"z>\">l</a> <b title='no end>t</b>", ["l t"]),
    ("a < b and c > d", ["a < b and c > d"]),
    ("<p>wo<b>r</b>d</p>", ["word"]),
    ("", []),
    ("   ", []),
])
def test_blocks(page, want):
    assert [b.text for b in blocks(page)] == want


def test_what_is_known_bounds_the_features():
    page = '<div class="Big box"><p id=x>a</p></div><main><p>b</main><p>c'
    every, some = blocks(page), blocks(page, frozenset({"in:p", "name:box"}))
    assert [b.around for b in every] == [{"in:div", "name:big", "name:box", "named", "in:p", "name:x", "leaf:p"}, {"in:main", "in:p", "leaf:p"}, {"in:p", "leaf:p"}]
    assert [b.around for b in some] == [{"in:p", "name:box", "named", "leaf:p"}, {"in:main", "in:p", "leaf:p"}, {"in:p", "leaf:p"}]


N = 50_000
HOSTILE = {
    "no ends of tags": "<a " * 1_000_000,
    "no ends of declarations": "<!x " * N,
    "quotes that never match": '<a ">"' * N,
    "quotes of both kinds": """<a ">"'>'""" * N,
    "one quote too many": '<a href="' + "<b>x</b>" * N,
    "nested names": "".join(f'<div class="n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}">t' for i in range(100_000)),
    "ends of what is not open": "<div>" * N + "</p>" * N + "</section>" * N,
    "rows below other elements": "<li><div>" + "<center>" * N + "<li>" * N,
    "raw elements that don't end": "<svg>" * N + "<!--</svg>-->" + "<svg " * N + "<select>" * N,
    "raw elements that end too seldom": "<svg><svg></svg>" * N,
    "raw text": "<script>" * N + "<title" * N,
    "cells": "<table>" + "<tr><td>x" * N,
    "comments": "<!-- >" * N,
    "names": "<a" * N + ">" + "<" * N,
    "attributes": "<div " + "class=' style=\"" * N + ">" + "<div class" + " " * N + ">",
    "digits": "&#" + "1" * 100_000 + "; &#" + "0" * 100_000 + "65;" + "&" * N,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(model, name):
    """Pages that made searches start over at each tag; a second would be much for any of them, hours if work grew with the square."""
    import time

    began = time.perf_counter()
    model.text(HOSTILE[name])
    assert time.perf_counter() - began < 20


def test_deep_pages_take_little_memory(model):
    import tracemalloc

    page = HOSTILE["nested names"]
    tracemalloc.start()
    model.text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(page)


def _article(page):
    """The article's text by another way: Python's own parser, all that is in the article element."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.lines = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("p", "h1"):
                self.lines.append("")
            elif tag == "br":
                self.lines[-1] += " "

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag in ("p", "h1", "article"):
                self.lines.append("")

        def handle_data(self, data):
            if self.inside:
                self.lines[-1] += data

    r = Reader()
    r.feed(page)
    r.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in r.lines) if x)


def test_articles_of_the_tables_by_another_parser(spark):
    """Every page's text is its article's, as a parser that knows where these pages keep it reads that."""
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{H.SMALL}/pages.parquet").collect()}
    rows = html_extract.op10_html_text(spark, H.SMALL).collect()
    assert len(rows) == len(html) and all(r["text"] == _article(html[r["page_id"]]) for r in rows)


def test_hidden_and_unscripted_parts(model):
    page = (
        "<!DOCTYPE html><html><head><title>x</title></head><body{}><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><noscript>Please enable scripts to see "
        "this page.</noscript><article><h1>The title of it</h1><p>First words, and some more of them follow here.</p><div hidden><p>More that is read at a click, as long as "
        "others are.</p></div><p>Where it ends, the words end too.</p></article><div hidden><a href=x>Menu one</a> <a href=y>two</a></div><footer>&copy; 2020 x.</footer></body></html>"
    )
    want = "The title of it\nFirst words, and some more of them follow here.\nMore that is read at a click, as long as others are.\nWhere it ends, the words end too."
    assert model.text(page.format("")) == want == model.text(page.format(' style="display:none"'))


def test_viterbi_finds_the_best_labels():
    """Against all labellings."""
    import itertools

    rng = np.random.default_rng(4)
    found = blocks("<p>a b c. d.</p><li>x</li><h1>Title</h1><div>footer text</div><p>e f.</p>")
    names = sorted({f for b in found for f in html_extract.features(b)})
    for _ in range(40):
        m = html_extract.Model({f: i for i, f in enumerate(names)}, rng.normal(size=len(names)), rng.normal(size=(2, 2)), rng.normal(size=2))
        emit = [sum(m.weights[m.index[f]] for f in html_extract.features(b)) for b in found]
        score = lambda y: m.start[y[0]] + sum(e * k for e, k in zip(emit, y, strict=True)) + sum(m.moves[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert m.decode(found) == list(max(itertools.product((0, 1), repeat=len(found)), key=score))


def test_gradient_counts_are_those_of_all_labellings():
    import itertools

    rng = np.random.default_rng(5)
    emit, moves, start = rng.normal(size=(2, 4)), rng.normal(size=(2, 2)), rng.normal(size=2)
    length = np.array([4, 3])
    marginal, pairs = html_extract._expectations(emit, length, moves, start)
    want, want_pairs = np.zeros((2, 4)), np.zeros((2, 2))
    for p in (0, 1):
        ys = list(itertools.product((0, 1), repeat=int(length[p])))
        s = np.array([start[y[0]] + sum(emit[p, k] * v for k, v in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)) for y in ys])
        w = np.exp(s) / np.exp(s).sum()
        for y, x in zip(ys, w, strict=True):
            want[p, : len(y)] += x * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                want_pairs[a, b] += x
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs)


def test_pages(spark):
    rows = html_extract.op10_html_text(spark, H.TINY).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{H.TINY}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["text"] == html_extract.default_model().text(html[r["page_id"]])
        assert r["text"] and "\n\n" not in r["text"] and "©" not in r["text"] and "track(" not in r["text"]


def test_odd_rows(spark):
    big = "<article>" + "<p>Some words of the article, and more.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", big), (4, "u", big), (None, "u", "<article><h1>T</h1><p>Text here.</p></article>"), (5, "u", "<nav><a href=x>y</a></nav>"), (6, "u", "<" * 5000)]
    docs = spark.createDataFrame(rows, PAGE)
    got = html_extract.extract(docs).collect()
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == by[3]["text"] == by[5]["text"] == ""
    assert by[4]["text"].count("\n") == 19_999 and by[None]["text"] == "T\nText here."
    clash = html_extract.extract(docs.withColumnsRenamed({"url": "text"})).columns
    assert clash == ["page_id", "html", "text", "n_chars"]
    assert html_extract.extract(docs.withColumnRenamed("url", "__html")).columns == ["page_id", "__html", "html", "text", "n_chars"]
    assert html_extract.extract(docs.limit(0)).count() == 0
