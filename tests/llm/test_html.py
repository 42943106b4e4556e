import html
import re
import time

import pytest

from tidemark.llm import html_text

BODY = "<p>" + "words and more words in a sentence. " * 8 + "</p>"


def page(inner, before="", after=""):
    return f"<html><head><title>t</title><style>x</style><script>var a='</p>'</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav>{before}<article>{inner}</article>{after}<footer>&copy; foot text here</footer></body></html>"


def plain(inner):
    return "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</p>|</h1>|<p>|</?li>", inner)) if x)


def test_boilerplate():
    for noise in ("<aside>side text, quite long and dense, with no link at all</aside>", '<div class="ad">An advert of one long sentence without any tag in it at all.</div>', '<div id="cookie-notice">We use cookies. ' + "More words. " * 30 + "</div>", "<form><p>Sign up for more. Sign up for more.</p></form>", '<section class="comments"><h2>Comments</h2>' + "<p>A reader says something long here.</p>" * 9 + "</section>", '<div class="sidebar"><p>Popular: one, two</p></div>', "<header><p>Site header text</p></header>", '<div role="navigation"><a href=1>a</a></div>'):
        for p in (page(BODY * 3, noise), page(BODY * 3, "", noise), page(BODY * 3 + noise)):
            assert html_text.main_text(p) == plain(BODY * 3)


def test_no_article_element():
    p = page("", f"<div><div><h1>Title</h1>{BODY * 4}<p>Short.</p></div></div>").replace("article", "div")
    assert html_text.main_text(p) == plain(f"<h1>Title</h1>{BODY * 4}<p>Short.</p>")
    many = "".join(f"<div>{BODY * 2}</div>" for _ in range(5))
    assert html_text.main_text(f"<body><nav><a href=x>menu</a></nav>{many}</body>") == plain(many)


@pytest.mark.parametrize("inner", ["<figure><img src=x><figcaption>A caption of the picture.</figcaption></figure>", "<label>Label of a chart</label>", '<section id="market-share"><h2>Market share</h2><p>It grew.</p></section>', '<section class="search"><p>How to search well.</p></section>', '<div class="alert"><p>Mind the gap.</p></div>', "<header><h1>Title in a header</h1></header>", '<div class="post-header"><h2>Title in a div</h2></div>', "<fieldset><legend>Legend</legend>Inside.</fieldset>", '<div class="side"><p>One side of it.</p></div>'])
def test_nothing_of_the_article_is_lost(inner):
    assert html_text.main_text(page(BODY + inner + BODY)) == plain(re.sub("</?(figure|figcaption|label|section|div|header|fieldset|legend|img)[^>]*>", "</p>", BODY + inner + BODY))


def test_pages_without_article():
    links = "<ul>" + "<li><a href=x>another page of this site</a></li>" * 12 + "</ul>"
    comments = "<h3>3 Comments</h3>" + "<div><b>reader</b><p>I think that this is quite right, and long too.</p></div>" * 3
    want = plain("<h1>Title</h1>" + BODY * 6)
    for p in (
        f"<body><header><h1>Site</h1><nav>{links}</nav></header><div><header><h1>Title</h1></header>{BODY * 6}</div><div>{links}</div></body>",
        f"<body><div id=page><div class=left>{links}</div><div><h1>Title</h1><div>{BODY * 6}</div></div><div>{comments}</div></div></body>",
        f"<body><main><h1>Title</h1>{BODY * 3}<div class=ad><p>Buy it, buy it, buy it now.</p></div>{BODY * 3}{links}</main></body>",
        f"<body><div><h1>Title</h1>{BODY * 3}<div class='x ad-slot'>{BODY}</div>{BODY * 3}</div><div><div>{links}<div><div>{links}</div></div></div></div></body>",
    ):
        assert html_text.main_text(p) == want
    assert html_text.main_text(page("<h1>Title</h1>" + BODY * 6, "", f"<div>{comments}</div>")) == want


@pytest.mark.parametrize("hostile", ["<div>" * 50_000, "<b>" * 50_000, "</p>" * 50_000, "<div>" * 25_000 + "</i>" * 25_000, "<div><b>" * 20_000 + "</i></p>" * 20_000, "<p><i>" * 30_000, "<a " * 50_000, '<a "' * 50_000, "<a '\"" * 50_000, "<" * 100_000, "<li>" * 50_000, "<td><table>" * 20_000, "<body>" * 50_000, "<!--" * 50_000, "<script" * 50_000, "<article><p>x" * 20_000, "<h2>Comments" * 20_000, "</" * 50_000])
def test_time_is_linear(hostile):
    began = time.perf_counter()
    html_text.main_text(f"<body>{BODY}{hostile}")
    html_text.main_text(f"<body><article>{BODY}</article>{hostile} x >")
    assert time.perf_counter() - began < 4


def test_blocks_and_references():
    p = page("<h1>A &amp; B &eacute;</h1><p>x\n  y&nbsp;<b>bold</b>er <a href='q'>link</a>\t.<p>open <i>two<br>three<ul><li>one<li>two</ul>")
    assert html_text.main_text(p) == "A & B é\nx y bolder link .\nopen two three\none\ntwo"


def test_odd_pages():
    for p in (None, "", " ", "<p", "<!-- x", "<script>x", "</p></p>", "<nav>menu</nav>", "<a" + " x" * 1000):
        assert html_text.main_text(p) == ""
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<p>cut off <b>text</b> here</p><p class='a") == "cut off text here"
    deep = "<div>" * 20_000 + "deep words" + "</div>" * 20_000
    assert html_text.main_text(deep) == "deep words"
    long = page("<p>" + "word " * 200_000 + "</p>")
    assert len(html_text.main_text(long)) == 5 * 200_000 - 1


def test_table(spark):
    df = spark.createDataFrame([(1, "u", page(BODY), 9, "t"), (1, "u", page(BODY), 9, "t"), (2, None, None, None, None), (None, "v", "", 1, "x")], "page_id long, url string, html string, n_chars int, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(map(tuple, got.collect()), key=str)
    t = plain(BODY)
    assert rows == sorted([(1, "u", t, len(t)), (1, "u", t, len(t)), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_text.extract(df.where("false")).count() == 0


def test_query(spark, sf):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op5_main_text(spark, sf).collect():
        inner = re.search("<article>(.*?)(</article>|$)", rows[r.page_id], re.S)[1]
        assert r.text == plain(inner) and r.n_chars == len(r.text)
