import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamspark.llm import html_text

SMALL = "/root/testdata/sf0.01"


def test_blocks_references_and_boilerplate():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var x="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="ad">buy</div><div class="cookie-notice">cookies</div>
    <article><h1>Title &amp; more</h1><p>One <b>bold</b>
      two&nbsp;three<p>Next&#33; <br>line</p><ul><li>a<li>b</ul><form>f</form><aside>s</aside></article>
    <div id="comments"><p>first!</p></div><footer>foot</footer></body></html>"""
    assert html_text.extract(page) == "Title & more\nOne bold two three\nNext! line\na\nb"


def test_odd_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x") == ""
    assert html_text.extract("plain &lt;text&gt;") == "plain <text>"
    assert html_text.extract("<p>a<!-- <p>b --><p>c") == "a\nc"
    assert html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.extract("<p>" + "long " * 50_000) == ("long " * 50_000).strip()


def test_wrapper_of_unmarked_pages(spark):
    """Pages without <article>: what all pages of the host share is template, the varying slots are content."""
    page = lambda k: f"<html><body><div class=top>My Site</div><div class=x1>All about us</div><div class=x2><p>Story {k} begins here and goes on for a while.</p><p>It ends {k * 7}.</p></div><div class=x3>Imprint of the site</div></body></html>"
    rows = [(k, f"http://h.com/{k}", page(k)) for k in range(12)] + [(99, "http://lone.com/1", page(99)), (100, None, page(100)), (101, "http://h.com/x", None)]
    pages = spark.createDataFrame([(*r, "own", 3) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    out = {r["page_id"]: r for r in html_text.extracted(pages).collect()}
    for k in range(12):
        assert out[k]["text"] == f"Story {k} begins here and goes on for a while.\nIt ends {k * 7}."
    assert out[101]["text"] == "" and out[101]["n_chars"] == 0
    assert "Story 99" in out[99]["text"] and "Story 100" in out[100]["text"]
    assert len(out) == len(rows) and out[3]["host"] == 3


class Article(HTMLParser):
    """An independent reading of pages that mark their article: the library's parser, text inside <article>, a line for each block."""

    BLOCKS = {"p", "h1", "h2", "ul", "li", "div", "article"}

    def __init__(self, tag="article"):
        super().__init__(convert_charrefs=True)
        self.tag, self.depth, self.lines = tag, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == self.tag
        self.lines += [""] * (tag in self.BLOCKS)
        self.lines[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.lines += [""] * (tag in self.BLOCKS)
        self.depth -= tag == self.tag

    def handle_data(self, data):
        if self.depth:
            self.lines[-1] += data

    @classmethod
    def read(cls, page):
        self = cls()
        self.feed(page)
        self.close()
        return "\n".join(x for x in (" ".join(y.split()) for y in self.lines) if x)


def test_whole_table(spark):
    out = {r["page_id"]: r for r in html_text.op9_html(spark, SMALL).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert out.keys() == pages.keys()
    for i, h in pages.items():
        assert out[i]["n_chars"] == len(out[i]["text"])
        assert out[i]["text"] == Article.read(h)


@pytest.mark.parametrize("tags", [("", ""), ('<div class="x7">', "</div>")])
def test_articles_are_found_without_their_tags(spark, tags):
    """Alignment and slots alone: no <article> on any page. Whole texts, word for word, on all pages."""
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    bare = [(r["page_id"], r["url"], r["html"].replace("<article>", tags[0]).replace("</article>", tags[1])) for r in rows]
    out = {r["page_id"]: r["text"] for r in html_text.extracted(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert out == {r["page_id"]: Article.read(r["html"]) for r in rows}


def plain_matching(a, b):
    """Simple tree matching as in the textbook. A tree is (label, children)."""
    if a[0] != b[0]:
        return 0
    w = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            w[i][j] = max(w[i - 1][j], w[i][j - 1], w[i - 1][j - 1] + plain_matching(x, y))
    return 1 + w[-1][-1]


TREES = st.recursive(st.tuples(st.sampled_from("abc"), st.just(())), lambda kids: st.tuples(st.sampled_from("ab"), st.lists(kids, max_size=5).map(tuple)), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(TREES, TREES)
def test_matching_equals_the_textbook(a, b):
    def tree(x):
        def page(y):
            return f"<{y[0]}-x>{''.join(map(page, y[1]))}</{y[0]}-x>"

        return html_text.Tree(html_text.parse(page(x)))

    m, (s, t) = html_text.Matching(), (tree(a), tree(b))
    p, q = m.number(s), m.number(t)
    assert m.score(p[0], q[0]) == 1 + plain_matching(a, b)
    pairs = list(m.pairs(s, p, t, q))
    assert len(pairs) == 1 + plain_matching(a, b) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
    assert all(s.sig[x] == t.sig[y] for x, y in pairs)
    place = dict(pairs)
    assert all(place[s.up[x]] == t.up[y] for x, y in pairs if x)


def test_large_alignments_are_halved(monkeypatch):
    """Hirschberg's halves give a matching of the same size."""
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, (5, 6))
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 40))
        *_, row = html_text.Matching._rows(m, a, b)
        *_, head = html_text.Matching._rows(m, a[: len(a) // 2], b)
        *_, tail = html_text.Matching._rows(m, a[len(a) // 2 :][::-1], b[::-1])
        assert (head + tail[::-1]).max() == row[-1]


def test_time_is_linear():
    began = time.time()
    for page in ("<a " * 300_000, "<svg/>" * 50_000, "<div>" * 30_000 + "</article>" * 30_000, "<b>" * 30_000 + "<div></div>" * 30_000, "<p><button>" + "<b>" * 30_000 + "<div></div>" * 30_000, "<!--" * 100_000, '<a b="' * 100_000, "<a b='\">" * 30_000, "</" * 100_000 + ">"):
        html_text.extract(page)
    assert time.time() - began < 30


def test_content_is_not_lost_to_its_surroundings():
    assert html_text.extract('<div class="page no-sidebar"><article><p>Hello world</p></article></div>') == "Hello world"
    assert html_text.extract('<form id="aspnetForm"><article><p>In a form</p></article></form>') == "In a form"
    assert html_text.extract('<form><p>The whole page is a form.</p></form>') == "The whole page is a form."
    assert html_text.extract('<div id="related-work"><p>Paper section</p></div>') == "Paper section"
    assert html_text.extract('<article><header><h1>T</h1></header><p>a <math>x</math> <span class="share">share</span></p></article>') == "T\na x share"
    assert html_text.extract('<header><h1>Site</h1></header><main><p>text</p></main><div id="comments"><article>first!</article></div>') == "text"


def test_copies_of_an_article_are_no_template():
    page = lambda k, text: f"<body><ul><li>menu {k}</li></ul><article><p>{text}</p></article><div>imprint</div></body>"
    same = [page(k, "One article under many addresses of the host.") for k in range(6)]
    assert html_text.extract(same[0], html_text.induce(same)) == "One article under many addresses of the host."
    mixed = [*same[:4], *(page(k, f"Another article, number {k}.") for k in range(4))]
    assert html_text.extract(same[0], html_text.induce(mixed)) == "One article under many addresses of the host."


def test_repeated_rows(spark):
    rows = [(1, "http://h.com/1", "<p>a</p>")] * 3 + [(2, "http://h.com/2", "<p>b</p>")] * 2
    out = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in out) == [(1, "a")] * 3 + [(2, "b")] * 2


def test_wrappers_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html_text, "WRAPPER_BYTES", 0)
    out = {r["page_id"]: r["text"] for r in html_text.op9_html(spark, SMALL).collect()}
    assert out == {r["page_id"]: Article.read(r["html"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}


def test_empty(spark):
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_layout_names_keep_the_article():
    for name in ("content-sidebar-wrap", "has-sidebar", "no-comments", "nav-open", "sidebar", "widget-area"):
        assert html_text.extract(f'<body><div class="{name}"><article><p>The story.</p></article></div></body>') == "The story."
    page = '<article><p class="related-work">Others did so.</p><section id="social-policy"><p>Policy.</p></section><div class="share-buttons">x</div></article><div id="comments"><article>first!</article></div>'
    assert html_text.extract(page) == "Others did so.\nPolicy."
    assert html_text.extract(f'<body><p>Title</p><div id="widget">{"long text " * 30}</div><div class="ad-slot">buy</div></body>') == "Title\n" + ("long text " * 30).strip()


def test_slots_inside_constant_text():
    page = lambda k: f"<body><div class=top>My Site</div><div class=story>Story: <p>It was day {k} of the long journey.</p><p>By <b>name{k}</b></p></div></body>"
    wrapper = html_text.induce([page(k) for k in range(6)])
    assert html_text.extract(page(3), wrapper) == "It was day 3 of the long journey.\nname3"


def test_large_deep_and_odd_pages():
    """Neither size nor depth nor one page of another layout costs a host its template."""
    story = lambda k: f"<div class=s><p>Story {k} goes on {k * 7} times.</p></div>"
    links = "".join(f"<div>link {j}</div>" for j in range(6000))
    wide = lambda k: f"<body><div class=x>{links}</div>{story(k)}</body>"
    deep = lambda k: f"<body><div class=x>{'<div>' * 2000}Imprint{'</div>' * 2000}</div>{story(k)}</body>"
    plain = lambda k: f"<body><div class=x>Imprint</div>{story(k)}</body>"
    for page in (wide, deep, plain):
        pages = [page(k) for k in range(4)]
        if page is plain:
            pages[0] = "<body><table><tr><td>another layout</td></tr></table></body>"
        assert html_text.extract(page(3), html_text.induce(pages)) == "Story 3 goes on 21 times."
