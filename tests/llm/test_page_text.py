"""Main text of hand-made pages."""

import pytest

from panelloom.llm.page_text import LABELLED, classify, extract, grow, main_text

TREE = grow(LABELLED)
LONG = "Plenty of words stand in this paragraph so that anyone can see it is a part of the article and of nothing else at all"
MORE = "Another long paragraph follows the first one and goes on about the very same matter for quite a while before it ends"

PAGES = {
    f'<html><head><title>T</title><script>var t="</p>";x(1)</script></head><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this thing now please do.</div><article><h1>Title here</h1><p><b>{LONG} &amp;amp; &lt;b&gt;.<br><p>Es.</p><p>{MORE}</p></article><footer>&copy; me &middot; imprint.</footer></body></html>': f"Title here\n{LONG} &amp; <b>.\nEs.\n{MORE}",
    f"<article><header><h1>Head line</h1></header><p>{LONG}</p><section class='comments'><h2>Comments</h2><p>{MORE}</p></section><aside>{LONG}</aside><form><p>{MORE}</p><input></form></article><div id=sidebar><p>{LONG}</p></div>": f"Head line\n{LONG}",
    f"<div class='header'><a href=/>Home</a> <a href=/x>News</a></div><div class=content><p>{LONG}</p>\n<p>a   b\n\tc</p></div><div class='cookie-notice'>{MORE}</div>": f"{LONG}\na b c",
    f"<body><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p><ul><li><a href=1>x</a><li><a href=2>y</a></ul>": f"{LONG}\n{MORE}\n{LONG}",
    f"<main><p>{LONG}</p><p>cut off <a hre": f"{LONG}\ncut off",
    f"<article><p>{LONG}</p><script>unclosed {MORE}": LONG,
    f"<article><p>{LONG}</p><!-- unclosed {MORE}": LONG,
    f"<ARTICLE><P TITLE='a>b'>{LONG}<P>caf&eacute;&#233;&#xe9;&nbsp;x &am</ARTICLE>": f"{LONG}\ncafééé x &am",
    f"<article><p>{LONG} <a href=x>with a link</a> inside</p><p><em>x</em>y</p></article>": f"{LONG} with a link inside\nxy",
    f"<div id='pageHeader'>Site name and slogan of the site</div><div class='entry'><div class='entry-header'><h1>Head</h1></div><p>{LONG}</p><div class='userComments'><p>{MORE}</p></div><div class=adBox>{MORE}</div></div>": f"Head\n{LONG}",
    "<nav>a</nav>": "",
    "": "",
    None: "",
    "<": "",
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_page(page):
    assert main_text(page, TREE) == PAGES[page]


def test_tree_fits_its_table():
    assert (classify(TREE, LABELLED[:, :-1]) == (LABELLED[:, -1] > 0)).all()


def test_query(spark):
    rows = [(i, p, "u") for i, p in enumerate(PAGES)] + [(None, "", "u"), (0, next(iter(PAGES)), "u")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(frame).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted((str(i), PAGES[p]) for i, p, _ in rows)
    assert extract(frame.limit(0)).count() == 0


def test_given_pages(spark):
    """In the given tables the article element says what the main text is."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.DOTALL)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert main_text(r.html, TREE) == "\n".join(x for x in want if x)


@pytest.mark.parametrize("lead", ["<html><head><title>T</title><body><header><a href=/>Home</a></header>", "<body><p><select><option>x</p><selected></selected>", "<body><object><objects></objects>", "<body><map name=m><mapping></mapping>"])
def test_end_tags_of_longer_names(lead):
    """</header> does not end a head that is left open, and so on."""
    found = main_text(f"{lead}<article><p>{LONG}</p><p>{MORE}</p></article>", TREE)
    assert LONG in str(found) and MORE in str(found)


LOST = [
    f"<div class='content sidebar-layout with sidebar'><p>{LONG}</p><p>{MORE}</p></div>",
    f"<div class='legal'><article><p>{LONG}</p><p>{MORE}</p></article></div>",
    f"<div id='main' class='content side-by-side'><p>{LONG}</p><p>{MORE}</p></div>",
    f"<div class='site-search-results main'><p>{LONG}</p><p>{MORE}</p></div>",
    f"<article><p title='it's'>{LONG}</p><p data-x=\"a>b\">{MORE}</p></article>",
    f"<body><form id=aspnet><article><p>{LONG}</p><p>{MORE}</p></article></form>",
]


@pytest.mark.parametrize("page", LOST)
def test_pages_lost_before(page):
    assert main_text(page, TREE) == f"{LONG}\n{MORE}"


def test_single_short_paragraph():
    assert main_text("<p>eight short words stand in this paragraph here</p>", TREE) == "eight short words stand in this paragraph here"


def test_comments_are_no_articles():
    page = f"<article><p>{LONG}</p></article><div id='comments'><article><p>{MORE}</p></article><article class='comment'><p>{MORE}</p></article></div>"
    assert main_text(page, TREE) == LONG


@pytest.mark.parametrize("piece", ["<svg>", "<noscript>", "<select><option>", "<p title='", "<a href=\"", "<!-- ", "<div class=x", "<![CDATA[", "= '"])
def test_linear_time(piece):
    import time

    began = time.time()
    main_text(piece * (1_000_000 // len(piece)), TREE)
    assert time.time() - began < 20


def test_very_long_page(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    row = extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert row.text == "\n".join([LONG] * 20_000)


def test_held_out_pages(spark):
    """Pages of the larger tables, whose article elements say what the main text is, and the same without these elements."""
    import html
    import re

    whole = right = plain = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(300).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.DOTALL)[1]
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)) if x)
        whole += 1
        right += main_text(r.html, TREE) == want
        plain += main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>"), TREE) == want
    assert right == whole and plain >= 0.9 * whole
