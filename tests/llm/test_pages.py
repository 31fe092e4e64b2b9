"""Main text of pages: golden texts of several layouts, odd markup, time over long pages, empty tables and clashing columns."""

import time

import pytest

from riskloom.llm import html_text

FIRST = "The council voted on Monday to repair the old bridge, which has been closed to traffic since the winter storms."
SECOND = "Engineers expect the work to take nine months &amp; cost two million, and said that the ferry would run in the meantime."
THIRD = "Residents on the north bank welcomed the plan, though some asked why it had taken a year to reach a decision."
TEXT = "\n\n".join(["Bridge to be repaired", FIRST, SECOND.replace("&amp;", "&"), THIRD])
BODY = f"<h1>Bridge to be repaired</h1><p>{FIRST}</p>\n<p>{SECOND}</p><p>{THIRD}</p>"
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/sport'>Sport</a></li></ul>"
LAYOUTS = {
    "article": f"<html><head><title>T</title><style>p {{}}</style></head><body><header><a href='/'>Site</a></header><nav>{MENU}</nav><article>{BODY}</article><footer><p>&copy; 2024 Site</p></footer></body></html>",
    "main with sidebar": f"<body><nav class='top-nav'>{MENU}</nav><main>{BODY}</main><aside class='sidebar'><h3>Most read</h3>{MENU}</aside><footer>&copy; Site. All rights reserved.</footer></body>",
    "divs by class": f"<body><div id='header' class='masthead'><a href='/'>Site</a></div><div class='menu'>{MENU}</div><div class='post-content'>{BODY}</div><div class='footer'><p>&copy; Site</p></div></body>",
    "advert and notice inside": f"<body><div class='cookie-banner'><p>We use cookies to improve the site.</p></div><article>{BODY.replace('<p>' + THIRD, '<div class=ad><p>Buy now and save a lot.</p></div><p>' + THIRD)}</article></body>",
    "comments after": f"<body><article>{BODY}</article><section class='comments' id='comments'><h2>Comments</h2><div class='comment'><p>I live there and I agree.</p></div></section></body>",
    "script and form": f"<body><script>var a = '<p>not text</p>';</script><article>{BODY}<form class='newsletter'><p>Sign up for our letter.</p><input></form></article><noscript><p>Turn it on.</p></noscript></body>",
    "unclosed": f"<body><nav>{MENU}</nav><article><h1>Bridge to be repaired<p>{FIRST}<p>{SECOND}<p>{THIRD}</article><footer><p>&copy; Site</footer>",
}


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", LAYOUTS)
def test_golden_texts(model, name):
    assert html_text.main_text(model, LAYOUTS[name]) == TEXT


@pytest.mark.parametrize("unit", ["<div>t", "<p>it's <b 'x ", "<p>it's <b x='", "<b><i>t", "</u><b>", "<li>t", '<p class="x ', "<b><p>t", "<td>x<table>", "<script </script ", "<div class='a b' id=c>t", "<p hidden", "<!-"])
def test_time_is_linear_in_the_page(model, unit):
    page = "<u>" + unit * ((1 << 20) // len(unit))
    start = time.time()
    html_text.main_text(model, page)
    assert time.time() - start < 20  # 5 s and less each on an idle machine


def test_tags_are_read_as_browsers_read_them():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    assert texts("<p>it's <b 'x>bold</b> text</p>") == ["it's bold text"]  # a quote opens a value only after an equals sign
    assert texts("<p title='a > b'>one</p><p title=\"it's\">two</p>") == ["one", "two"]
    assert texts("<p title='never closed>one</p><p>two</p>") == ["one", "two"]
    assert texts("<p a = 'x' b=\"y>z\" c=d/e>one<br/>two</p>") == ["one two"]
    assert texts("<article><p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds</p></article>") == ["sum x+1 holds"]
    assert texts("<p>1 < 2 and <3</p>") == ["1 < 2 and <3"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert texts("<div><u>a<div></u>b</div></div>c") == ["a", "b", "c"]
    assert texts("<a href=x>one<div>two</a>three</div>") == ["one", "two", "three"]


def test_ancestors_are_told_however_deep():
    deep = html_text.leaf_blocks("<nav>" + "<div class='box'>" * 3000 + "in</nav>out")
    assert deep[0].tags == {"nav"} and deep[1].tags == frozenset()
    named = html_text.leaf_blocks("<div class='Sidebar related'><div id=story><p>x</p></div><p>y</p></div><p>z</p>")
    assert [b.names for b in named] == [{"side", "good"}, {"side"}, frozenset()]


def test_empty_table_and_clashing_columns(spark, model):
    frame = spark.createDataFrame([(1, "u", LAYOUTS["article"], "mine", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    rows = {r.page_id: r for r in html_text.extract_main_text(frame, html_text.fit(frame)).collect()}
    assert rows[1].text == TEXT and rows[1].n_chars == len(TEXT) and rows[None].text == ""
    assert html_text.extract_main_text(frame.limit(0), html_text.fit(frame.limit(0))).count() == 0
