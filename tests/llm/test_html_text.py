import re
from html import unescape

import pyarrow.parquet as pq

from ripplet.llm import html_text as H


def text(html):
    return H.parse(html).text(None)


def test_a_page_with_everything_around_the_article():
    html = """<html><head><title>T</title><script>if (a<b) { "</p>" }</script></head><body class="home">
    <header class="site"><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
    <div id="cookie-notice">We use cookies</div>
    <div class="layout"><div class="sidebar">Popular things</div>
    <div class="post-content"><h2>Head&nbsp;line &amp; more</h2><p>First   <b>bold</b>
    text<br>next &lt;line&gt;.<p>Second <a href=x>link</a> paragraph &copy; 2020.</p>
    <div class="ad-slot">Buy now</div><blockquote>A quote.</blockquote><ul><li>one<li>two</ul>
    <form><p>Your mail</p></form></div>
    <div id="comments"><h3>2 comments</h3><p>I think this is a very long reader comment that goes on and on and on, longer than the article itself, to be sure.</p></div></div>
    <aside>Side</aside><!-- <p>not this</p> --><footer>&copy; Foot</footer></body></html>"""
    assert text(html) == "Head line & more\nFirst bold text next <line>.\nSecond link paragraph © 2020.\nA quote.\none\ntwo"


def test_odd_pages():
    assert text(None) == text("") == text("<!-- x") == ""
    assert text("plain words only") == "plain words only"
    assert text('<div class="sidebar">all there is</div>') == "all there is"
    assert text("<article><p>a<p>b") == "a\nb"
    assert text("<p>x</b></p></div>y") == "x\ny"


def test_the_host_decides(spark):
    page = lambda main, other: f'<body><div class="story{len(main)}"><p>{main}</p></div><div class="box"><p>{other}</p></div></body>'
    rows = [(i, "http://A.b/x", page("main text here " * 9, "other")) for i in range(5)] + [(9, "http://a.b/y", page("short", "a longer other text " * 20)), (10, None, "<p>x</p>"), (11, "http://c/", None)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short" and got[0] == ("main text here " * 9).strip() and got[10] == "x" and got[11] == ""
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_against_its_articles(spark):
    """On these pages the article element is all of the main text."""
    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r.page_id: r.text for r in H.extract(spark.read.parquet(path)).collect()}
    for r in pq.read_table(path).to_pylist():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))).strip() for b in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


ARTICLE = "<p>" + "The first paragraph says a good deal. " * 5 + "</p><p>" + "The second one goes on about it. " * 5 + "</p>"
TEXT = "\n".join([("The first paragraph says a good deal. " * 5).strip(), ("The second one goes on about it. " * 5).strip()])


def test_names_that_only_mention_other_things_drop_no_article():
    for wrap in ('<div class="content-sidebar-wrap">{}</div>', '<div class="no-sidebar">{}</div>', '<div id=wrap class="with-navbar"><article>{}</article></div>', '<div class="has-comments sidebar-layout">{}</div>', '<div class="acme-menu-theme"><main>{}</main></div>', '<form id="aspnetForm">{}</form>', '<div class="sidebar-layout"><article>{}</article></div>', '<div class="sidebar"><article>{}</article></div>'):
        page = f'<body><div class="topbar">Top things</div>{wrap.format(ARTICLE)}<div class="site-footer">Foot</div></body>'
        assert text(page) == TEXT, wrap
    assert text(f'<article><h1>Cars</h1><section class="market-share"><h2>Share</h2>{ARTICLE}</section><div class="acme-share"><a href=x>Share this</a></div></article>') == "Cars\nShare\n" + TEXT
    assert text(f'<article>{ARTICLE}<div id="comments"><article class="comment"><p>{"I say so too. " * 90}</p></article></div></article>') == TEXT
    assert text(f'<div class="story">{ARTICLE}</div><div id="comments"><article class="comment"><p>I say so too.</p></article></div>') == TEXT


def test_elements_that_end_at_once_or_never_take_no_article():
    for inner in ('<svg class="i"/>', '<svg class="i" viewBox="0 0 1 1" />', '<math/>', '<svg class="i">', "<noscript>", "<object data=x>", '<svg><path d="M0"/></svg>', "<select><option>no</select>"):
        assert text(f"<h1>T</h1>{inner}{ARTICLE}") == "T\n" + TEXT, inner
    assert text(f"<h1>T</h1><script>var x = '</p>'; {ARTICLE}") == "T"


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "http://a/", f"<article>{ARTICLE}</article>", "x", "y", "z")] * 3 + [(None, None, None, None, None, None), (2, "http://a/", "<p>" + "long " * 400_000 + "</p>", "x", "y", "z")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, path string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(TEXT)), (1, len(TEXT)), (1, len(TEXT)), (2, 400_000 * 5 - 1)]
