from __future__ import annotations

import html
import re
import time

from trialweave.llm import dom, pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><div class=ad>Buy</div><main><article><header><h2>Head &amp; line</h2><p>By me</p></header>
<p>First <b>bold</b>
 text<br>next<p>Second &lt;x&gt;<script>var a = "</p>";</script><ul><li>one<li>two</ul><!-- <p>no</p> -->
<form><input><p>Mail</p></form><div style="display: none">gone</div></article>
<section id="comments"><article class="comment"><p>Reader</p></article></section></main><footer>&copy; F</footer></body></html>"""


def test_furniture_goes_and_blocks_stay_in_order():
    assert pages.extract_text(PAGE) == "Head & line\nFirst bold text next\nSecond <x>\none\ntwo"


def test_short_articles_and_what_is_beside_them_stay():
    long = "word " * 100 + "end"
    parts = f"<h1>Title</h1><article><p>Short one</p></article><article><p>{long}</p></article><p>Between</p><article><p>Last</p></article>"
    want = f"Title\nShort one\n{long}\nBetween\nLast"
    assert pages.extract_text(f"<body><main>{parts}</main></body>") == pages.extract_text(f"<body>{parts}</body>") == want
    assert pages.extract_text("<body><main><p>In main</p></main><article><p>Beside</p></article></body>") == "In main\nBeside"


def test_broken_markup():
    assert pages.extract_text(None) == pages.extract_text("") == ""
    assert pages.extract_text("just text &amp; more") == "just text & more"
    assert pages.extract_text("<p>a<b>b<p>c</b> d</i> < e <") == "ab\nc d < e <"
    assert pages.extract_text("<p>a</p><!-- open <p>b") == "a"
    assert pages.extract_text("<script>never closed <p>x") == ""
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert pages.extract_text(deep) == "deep"


def test_a_long_page_takes_linear_time():
    start = time.time()
    text = pages.extract_text("<article>" + "<p>word word" * 100_000 + "<a 'x" * 1000 + "</article>")
    assert text.count("\n") >= 99_999 - 1 and time.time() - start < 30


def test_alignment_is_the_largest_matching():
    a = dom.parse("<ul><li>1</li><li><b>2</b></li><p>x</p></ul>")
    b = dom.parse("<ul><li><b>9</b></li><p>y</p><p>z</p></ul>")
    size, pairs = dom.align(a, b)
    assert size == len(pairs) == 5  # the root, ul, one li with its b, one p
    assert dom.align(a, a)[0] == len(list(dom.elements(a)))


def make(spark, n, host="http://h.example/"):
    rows = [(i, f"{host}{i}", f"<body><article><p>Subscribe to us today</p><p>Story {i} is told here</p><p>End of {i}</p></article></body>") for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_constant_nodes_are_template_and_varying_ones_content(spark):
    texts = {r.page_id: r.text for r in pages.extract_pages(make(spark, 6)).collect()}
    assert texts == {i: f"Story {i} is told here\nEnd of {i}" for i in range(6)}
    few = {r.text for r in pages.extract_pages(make(spark, 4)).collect()}
    assert all(t.startswith("Subscribe") for t in few)


def test_a_stub_page_does_not_hide_the_template_of_its_host(spark):
    stub = spark.createDataFrame([(90, "http://h.example/90", "<p>Gone</p>"), (91, "http://h.example/91", "<body></body>")], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in pages.extract_pages(make(spark, 12).union(stub)).collect()}
    assert texts == {**{i: f"Story {i} is told here\nEnd of {i}" for i in range(12)}, 90: "Gone", 91: ""}


def test_copies_of_a_page_are_no_template(spark):
    copies = make(spark, 1).crossJoin(spark.range(30)).selectExpr("id AS page_id", "url", "html")
    assert {r.text for r in pages.extract_pages(copies).collect()} == {"Subscribe to us today\nStory 0 is told here\nEnd of 0"}


def test_edges(spark):
    rows = [(1, None, None), (2, "no host", "<p>x</p>"), (2, "no host", "<p>x</p>"), (None, "http://a.b/c", ""), (3, "http://A.b:80/c", "<p>é😀</p>")]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, host string, n_chars int")
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in pages.extract_pages(frame).collect()), key=str)
    assert out == sorted([(1, None, "", 0), (2, "no host", "x", 1), (2, "no host", "x", 1), (None, "http://a.b/c", "", 0), (3, "http://A.b:80/c", "é😀", 2)], key=str)
    assert pages.extract_pages(frame.where("page_id = 9")).count() == 0


def test_the_given_pages(spark, sf):
    """Their articles are h1 and p blocks; a pattern can read them."""
    given = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract_pages(given).collect()}
    for r in given.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))
