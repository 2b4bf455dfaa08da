"""Main text: every page of a table against a plain reading of its article, and pages of other make."""

import html
import re

import numpy as np
import pytest

from ordinalis.llm import html_text as ht
from ordinalis.llm.queries import QUERIES

LONG = "A paragraph of the article that holds enough words to be told from a menu, a footer or a short notice."
SF = "/root/testdata/sf0.01"


def article(page):
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op12_html_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


PAGES = {
    "furniture": (f"""<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
        <div id="cookie-notice"><p>We use cookies on this site, as every other site does as well.</p></div>
        <main><article><header><h1>Title &amp; more</h1></header><p>{LONG}</p><p>Be.</p><div class="ad"><p>{LONG}</p></div>
        <form><label>Mail</label><input></form><ul><li>One</li><li><a href=x>Two</a></li></ul><script>var a = "<p>no</p>";</script>
        <section class="comments"><article><p>{LONG}</p></article></section><p>End.</p></article></main>
        <aside><p>{LONG}</p></aside><footer>{LONG}</footer></body></html>""",
                  ["Title & more", LONG, "Be.", "One", "Two", "End."]),
    "no landmarks": (f"""<body><div class="menu"><a href=1>a</a><a href=2>b</a></div><div><h2>Head</h2><p>{LONG}</p><p>No.</p><p>{LONG}</p></div>
        <div><a href=3>c</a> <a href=4>d</a></div></body>""", ["Head", LONG, "No.", LONG]),
    "body alone": (f"<h1>Head</h1><p>{LONG}<p>Short.<p>{LONG}", ["Head", LONG, "Short.", LONG]),
    "form around": (f"<body><form><nav>x</nav><article><p>{LONG}</p></article></form></body>", [LONG]),
    "comments first": (f"<div id=comments><p>{LONG}</p></div><article><p>Few words.</p></article>", ["Few words."]),
    "references": ("<article><p>a&nbsp;&lt;b&gt; &amp;amp; &#233;&#x4E2D;\n\t c<br>d</p></article>", ["a <b> &amp; é中 c d"]),
    "cut tag": (f"<article><p>{LONG}</p><p>Tail <a hre", [LONG, "Tail"]),
    "cut script": (f"<article><p>{LONG}</p><script>var x = '<p>no</p>';", [LONG]),
    "cut comment": (f"<article><p>{LONG}</p><!-- no <p>no</p>", [LONG]),
    "odd declarations": (f"<![if IE]><p>{LONG}</p><![endif]><?php x ?><!x>", [LONG]),
    "stray ends": (f"</div></p></nav><article></section><p>{LONG}</p></b></article>", [LONG]),
    "open inside": (f"<nav><ul><li>a</nav><article><div class=ad><p>ad</p></article><main><p>{LONG}</p></main>", [LONG]),
    "hidden": (f"<article><p>{LONG}</p><div hidden><p>no</p></div><div style='display: none'>no</div></article>", [LONG]),
    "plain text": ("Only some text & no markup", ["Only some text & no markup"]),
    "table": ("<article><table><tr><td>a</td><td>b <i>c</i></td></tr></table></article>", ["a", "b c"]),
    "nothing": ("<nav>a</nav><footer>b</footer>", []),
    "blank": (" \n\t", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_made_pages(name):
    page, want = PAGES[name]
    assert ht.main_text(page) == "\n".join(want)


def test_odd_rows(spark):
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", deep), (3, "u", "<article>" + f"<p>{LONG}</p>" * 20_000), (4, "u", f"<p>{LONG}")] + [(4, "u", f"<p>{LONG}")]
    df = spark.createDataFrame([r + ("x", 1, 2) for r in rows], "page_id long, url string, html string, text string, n_chars int, mark int")
    got = sorted(((r["page_id"] or 0, r["url"], r["n_chars"]) for r in ht.extract_text(df).collect()), key=repr)
    n = len(LONG)
    assert got == sorted([(1, "u", 0), (2, None, 0), (0, "u", n), (3, "u", 20_000 * n + 19_999), (4, "u", n), (4, "u", n)], key=repr)
    assert ht.extract_text(df.limit(0)).count() == 0


def test_smoothing_and_threshold():
    x = np.array([0.0, 0, 0, 90, 100, 95, 0, 0])
    s = ht.smoothed(x, 1.0)
    k = [np.exp(-0.5 * d * d) for d in range(-3, 4)]
    want = sum(w * x[3 + d] for d, w in zip(range(-3, 4), k) if 0 <= 3 + d < 8) / sum(k)
    assert abs(s[3] - want) < 1e-9 and abs(ht.smoothed(np.full(5, 7.0), 1.0) - 7).max() < 1e-9
    t = ht.threshold(np.array([1.0, 2, 3, 100, 110]))
    assert 3 < t < 100 and ht.threshold(np.array([5.0, 5.0])) == 5.0
