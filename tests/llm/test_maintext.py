import html
import os
import re

import pytest

from sievekit.llm import maintext
from sievekit.llm.common import read
from tests.parity import FOLDER

P = "This is a long paragraph of the article number {}, with enough words, commas, and so on to count as text. It goes on a little."
ARTICLE = [P.format(i) for i in range(6)]
BODY = "".join(f"<p>{a}</p>\n" for a in ARTICLE) + "<p>Short end.</p>"
WANT = ["Head", *ARTICLE, "Short end."]
MENU = '<ul class="x1"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li><li><a href="/d">More</a></li></ul>'
OTHER = f"<p>{P.format(77)}</p><p>{P.format(78)}</p>"

PAGES = {
    "article": f"<html><head><title>T</title></head><body><header><h1>Site</h1></header>{MENU}<article><h1>Head</h1>{BODY}</article><footer>foot</footer></body></html>",
    "header in article": f"<body><article><header><h1>Head</h1></header>{BODY}<footer>By someone</footer></article></body>",
    "named parts": f'<body><div class="top">{MENU}</div><div id="content"><h1>Head</h1>{BODY}</div><div class="sidebar">{OTHER}</div><div id="comments">{OTHER}{OTHER}{OTHER}{OTHER}</div><div>Copyright 2020 all</div></body>',
    "no containers": f"<body>{MENU}<h1>Head</h1>{BODY}<div>Imprint, contact</div></body>",
    "unclosed": f'<body><div class=c><h1>Head{"".join("<p>" + a for a in ARTICLE)}<p>Short end.</div><form>{OTHER}<input></form>',
    "notice, advert, nested comments": f'<body><div class="cookieNotice">{OTHER}</div><main><h1>Head</h1><div class="ad-slot">{OTHER}</div>{BODY}<section class="comments"><h2>Comments</h2><article class="comment">{OTHER}{OTHER}{OTHER}{OTHER}</article></section></main></body>',
    "comments by their heading": f'<body><div><div><h1>Head</h1><div class="b">{BODY}</div><h2>3 Kommentare</h2><div>{OTHER}</div></div></div></body>',
    "layout table": f'<body><table><tr><td class="menu">{MENU}</td><td><h1>Head</h1>{BODY}</td></tr></table></body>',
    "wrapped paragraphs": f'<body><div class="t">{MENU}</div><div class="c"><h1>Head</h1>{"".join(f"<div class=q><p>{a}</p></div>" for a in ARTICLE)}<div class=q><p>Short end.</p></div></div><div class="f">Imprint</div></body>',
    "wrapper named after the sidebar": f'<body class="has-sidebar"><div class="with-sidebar"><h1>Head</h1>{BODY}</div><aside>{OTHER}</aside></body>',
    "unseen": f'<body><article><h1>Head</h1><script>var t = "</p><p>{P}";</script><style>p {{}}</style><noscript>{OTHER}</noscript><p hidden>{P}</p><div style="display: none">{OTHER}</div>{BODY}</article></body>',
    "cards beside and below the article": f'<body><article><h1>Head</h1>{BODY}<section class="related-posts"><article><h3>Other</h3>{OTHER}</article></section><div id="comments"><article>{OTHER}</article></div></article><div class="sideBar"><article>{OTHER}</article></div></body>',
    "marks in other spellings": f'<body><div class="pageWrap"><div class="side-bar">{OTHER}</div><div class="text"><h1>Head</h1>{BODY}</div><div id="newsletterSignup">{OTHER}</div></div></body>',
    "form around all": f'<body><form action="/"><div class="m">{MENU}</div><div class="c"><h1>Head</h1>{BODY}</div></form></body>',
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    assert maintext.blocks(PAGES[name]) == WANT


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []), ("<p>hello", ["hello"]), ("plain words", ["plain words"]), ("<script>a", []), ("<!-- a", []), ("<a href='", []), ("a < b > c", ["a < b > c"]),
        ("<article><p>A &lt;b&gt; &amp;amp; caf&eacute; &#8217;x&#x41;  y&nbsp;z\n\n w<br>v <b>b</b>old<sup>2</sup></p></article>", ["A <b> &amp; café ’xA y z w v bold2"]),
        ('<p title="a > b">x</p><P>y</P><!-- <p>z</p> --><p>w', ["x", "y", "w"]),
        ("<div>" * 3000 + "deep " * 30, [("deep " * 30).strip()]),
    ],
)
def test_markup(page, want):
    assert maintext.blocks(page) == want


def test_surges_and_dives():
    assert maintext.surges([0, 5, 0, 100, 0, 100, 0, 0, 0, 90, 0]) == [(3, 6), (9, 10)]
    assert maintext.surges([5, 0, 5, 0]) == [] and maintext.surges([]) == []
    assert maintext.surges([30, 0, 30, 0, 30, 0, 30]) == [(0, 7)]


def test_query_over_odd_pages(spark):
    rows = [(1, "u", None, 5), (2, None, "", 6), (None, "v", PAGES["article"], 7), (3, "w", PAGES["article"], 8), (3, "w", PAGES["article"], 8), (4, "x", "<p>" + "word " * 200_000, 9)]
    out = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((str(r.page_id), r.n_chars, len(r.text)) for r in out.collect())
    n = len("\n\n".join(WANT))
    assert found == sorted([("1", 0, 0), ("2", 0, 0), ("None", n, n), ("3", n, n), ("3", n, n), ("4", 999_999, 999_999)])
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_query_equals_the_pages_own_layout(spark):
    """The supplied pages have one layout, whose article is a stretch of text between two tags."""

    def brute(page):
        m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
        return "\n\n".join(b for b in blocks if b)

    want = {r.page_id: brute(r.html) for r in read(spark, FOLDER, "pages").collect()}
    found = maintext.op12_main_text(spark, FOLDER).collect()
    assert {r.page_id: r.text for r in found} == want and all(r.n_chars == len(r.text) for r in found)
