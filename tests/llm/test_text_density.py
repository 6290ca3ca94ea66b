"""Pages of several layouts, a plain version on the given ones, and odd rows."""

import html
import os
import re

import pytest

from marginalia.llm.queries import QUERIES
from marginalia.llm.text_density import composite, extract, main_text, page_texts

SF = "/root/testdata/sf0.001"
LONG = ["The quick brown fox jumps over the lazy dog while the cat looks on from the window sill.", "Rivers in the north carry less water each summer, and farmers downstream have begun to notice.", "Nobody had expected the bridge to stand for so long after the flood of the previous century."]
MENU = "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(12))


def plain(page: str) -> str:
    """The article element of the given pages, cut at its block tags."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op11_text_density"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def paragraphs(tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in LONG)


@pytest.mark.parametrize(
    "page",
    [
        # blocks without a name, a menu without one
        f"<body><div><ul>{MENU}</ul></div><div><div>{paragraphs()}</div></div><div>Copyright 2020 all rights reserved</div></body>",
        # everything named by class, the article by nothing
        f'<body><div class="cookie-notice"><p>{LONG[0]} {LONG[1]} {LONG[2]}</p></div><div id="nav">{MENU}</div><div class="text">{paragraphs()}</div><div class="sidebar"><p>{LONG[2]}</p><p>{LONG[1]}</p></div></body>',
        # readers' comments that outweigh the article, in articles of their own
        f'<body><main><article>{paragraphs()}</article><section id="comments"><h2>Comments</h2>' + "".join(f'<article class="comment-body"><p>{LONG[0]} {k}</p></article>' for k in range(9)) + "</section></main></body>",
        # an article whose wrapper has a name of a menu
        f'<body><div class="has sidebar"><article>{paragraphs()}</article><aside><p>{LONG[0]}</p></aside></div></body>',
        # forms, scripts with markup inside, a noscript notice, hidden parts
        f"<body><form><p>{LONG[0]}</p><input name=q></form><section>{paragraphs()}<script>document.write('<p>no</p>')</script><style>p > a {{}}</style></section><noscript>{LONG[1]}</noscript><div hidden>{LONG[0]}</div></body>",
        # unclosed paragraphs and a page that breaks off inside a tag
        f"<html><body><header><h1>Name of the site</h1></header><div>" + "".join(f"<p>{t}" for t in LONG) + '<p class="x',
        # lines parted by br
        f"<body><nav>{MENU}</nav><article><p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[2].replace(' ', '<br>', 1)}</p></article></body>",
    ],
)
def test_layouts(page):
    assert main_text(page) == "\n".join(LONG)


def test_blocks_and_references():
    assert main_text("<article><h1>A &amp; B</h1><p>one\n\t two&nbsp;&#233;<b>bold</b>ly &unknown; 3 &lt; 4</p><ul><li>x<li>y</ul></article>") == "A & B\none two ébold" + "ly &unknown; 3 < 4\nx\ny"
    assert main_text("<table><tr><td>a<td>b</tr><tr><td>c</table>") == "a b\nc"
    assert main_text("only words, no markup") == "only words, no markup"
    assert main_text("<p>1 < 2 and <!-- a > b --> <a href='x>y'>go</a></p>") == "1 < 2 and go"
    assert main_text('<div class="menu">all that there is</div>') == "all that there is"  # names alone never empty a page
    assert [main_text(x) for x in (None, "", "   ", "<html></html>", "<!-- x", "<script>p</script>")] == [""] * 6


def test_short_article_beats_long_menu():
    assert main_text(f"<body><nav>{MENU * 20}</nav><div><ul>{MENU}</ul></div><article><p>Short.</p></article></body>") == "Short."


def test_deep_and_long():
    deep = "<div>" * 30000 + LONG[0] + "</div>" * 30000
    assert main_text(deep) == LONG[0]
    many = "<article>" + f"<p>{LONG[1]}</p>" * 20000 + "</article>"
    assert main_text(many) == "\n".join([LONG[1]] * 20000)
    assert main_text("<" * 50000 + "a" * 50000).startswith("<<")
    assert len(main_text("</b><b>x" * 20000)) == 20000


def test_density_falls_with_links():
    assert composite(1000, 10, 0, 0, 0.1) > composite(1000, 10, 500, 5, 0.1) > composite(1000, 10, 1000, 10, 0.1) >= 0
    assert composite(0, 0, 0, 0, 0.0) == 0


def test_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>a</p>", None), (2, "v", "", "t"), (3, None, f"<p>{LONG[0]}</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(page_texts(pages).collect(), key=str)
    assert len(got) == 5 and sorted((r.text, r.n_chars) for r in got) == sorted([("", 0)] * 3 + [("a", 1), (LONG[0], len(LONG[0]))])
    assert extract(pages, "html", "n_chars").columns == ["page_id", "url", "text", "n_chars"]  # other columns stay
    assert page_texts(pages.limit(0)).collect() == []
