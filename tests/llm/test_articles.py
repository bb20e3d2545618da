import duckdb
import numpy as np
from pyspark.sql import Row

from tellmark.llm.articles import ORACLES, extract, leaf_blocks, made_model, made_pages, op11_html_extraction, train
from tellmark.llm.quality import viterbi


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_whole_tables_match_the_layout_in_sql(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
        got = op11_html_extraction(spark, sf)
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        want = con.sql(ORACLES["op11_html_extraction"]).select("page_id", "url", "text", "n_chars").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_held_out_blocks(spark):
    model = made_model()
    pages = made_pages(200, first=10**6)
    blocks = [leaf_blocks(h) for h, _ in pages]
    assert [len(b) for b in blocks] == [len(y) for _, y in pages]
    flat, owner = [x for b in blocks for x in b], np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    labels = np.array([y for _, ys in pages for y in ys])
    right = (viterbi(model.chain, model.features(flat, owner), owner) == labels).mean()
    print(len(flat), right)
    assert right >= 0.99


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="masthead"><a href="/">The Daily</a><p>All the news since ever, for you.</p></header>
<nav><ul><li><a href=1>Home</a></li><li><a href=2>World</a><li><a href=3>Sport</a></ul></nav>
<div class="cookie-consent"><p>We use cookies, as everybody does. Do you agree with that?</p><button>Yes</button></div>
<div id="main-content"><h1>A  title &amp; more</h1>
<p>First paragraph with <b>bold</b> words,
and a <a href="x">link in it</a>. It goes on &lt;here&gt;.<p>Short one.
<div class="sponsored"><p>Buy our fine things today, and save a lot of money.</p></div>
<h2>Part two</h2><ul><li>An item of the text, with words.</li><li>Another item of it.</ul>
<blockquote>What someone said about it, at some length.</blockquote>
<form><p>Tell us who you are, please.</p><label>Name</label><input><button>Send</button></form>
<p>Last one&nbsp;&#8211; done.</p></div>
<aside><h3>Related</h3><ul><li><a href=4>Another story that you may like</a></ul></aside>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this text very much, thank you.</p></div></section>
<footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer></body></html>"""


def test_a_page_of_every_kind(spark):
    df = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    assert extract(df).first().text.split("\n") == [
        "A title & more", "First paragraph with bold words, and a link in it. It goes on <here>.", "Short one.", "Part two", "An item of the text, with words.",
        "Another item of it.", "What someone said about it, at some length.", "Last one – done.",
    ]


def test_markup_is_read_as_far_as_it_goes():
    assert texts("a<b>b</b>c<br>d<p>e<p>f</div>g") == ["abc d", "e", "f", "g"]
    assert texts("<p>x < y &lt; z &am") == ["x < y < z &am"]
    assert texts("<p>x<p title='a>b'>y<p t=\"a>b>c</p>z") == ["x", "y", "b>c", "z"]
    assert texts("<script>var t='</p>';</script>a<style>b</style>c<script>d") == ["ac"]
    assert texts("a<!-- b <p> -->c<!-->d<!-- e") == ["acd"]
    assert texts("<p>a</p><p cla") == ["a"]
    assert texts("a<") == ["a<"] and texts("a</") == ["a</"] and texts("a</>b") == ["a</>b"] or texts("a</>b") == ["ab"]
    assert texts("") == [] and texts("<div></div> \n&nbsp;") == []
    within = {b.text: b.within for b in leaf_blocks("<ul class='a-Bc'><li>x<ul><li>y</ul><li>z</ul><table><tr><td>q<td>r</table>")}
    assert within["x"] == within["z"] == frozenset({"ul", ".a", ".bc", "li", ">li"}) and {"table", "tr", "td", ">td"} == within["r"]
    assert leaf_blocks("<p>ab <a>cd</a><p>e")[0].linked == 2 and leaf_blocks("<div><a>ab</div>cd")[1].linked == 0
    deep = "<div>" * 3000 + "x" + "<p>y" * 3000
    assert len(leaf_blocks(deep)) == 3001


def test_nulls_empties_long_pages_and_clashing_names(spark):
    long = "<article>" + "<p>Some words of a long text, again and again.</p>" * 20_000 + "</article>"
    pages = [None, "", "   ", "<", "no markup at all", "<nav><ul><li><a href=x>a</a></ul></nav>", long, "\x00<p>퟿</p>"]
    rows = [Row(page_id=None if i == 4 else i, url=None if i == 2 else "u", html=h, id="x", TEXT="t", n_chars=1) for i, h in enumerate(pages)]
    df = spark.createDataFrame(rows * 2)
    got = extract(df).collect()
    assert len(got) == 16 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (0, 1, 2, 5)] == [""] * 8
    assert {r.n_chars for r in got if r.page_id == 6} == {44 * 20_000 - 1}
    assert extract(df.limit(0)).count() == 0


def test_the_fit_is_the_same_in_every_run():
    pages = [(leaf_blocks(h), y) for h, y in made_pages(20)]
    a, b = train(pages), train(pages)
    assert a.marks == b.marks and np.array_equal(a.chain.emit, b.chain.emit)
