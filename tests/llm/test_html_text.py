"""Extraction of main texts: windows against a plain count, page templates by hand, odd input."""

import random

import numpy as np
import pytest

from tokenloom.llm import html_text as ht

P = [f"Sentence {i} of a paragraph that has some thirty words in it, so that nobody would take it for a menu, and ends here." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in P)
WANT = "\n".join(P)


def test_surges_against_a_plain_count():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.choice((0, 0, 0, 1, 40, 200)) for _ in range(rng.randrange(0, 25))]
        # two lines with text are in one stretch if fewer than a window of empty lines lie between
        want, at = [], [i for i, x in enumerate(w) if x]
        for i in at:
            if want and i - want[-1][1] < ht.WINDOW:
                want[-1][1] = i + 1
            else:
                want.append([i, i + 1])
        best = [max(sum(w[max(s, 0) : s + ht.WINDOW]) for s in range(a - ht.WINDOW + 1, b)) for a, b in want]
        assert ht.surges(np.array(w, dtype=np.int64)) == [(a, b, m) for (a, b), m in zip(want, best, strict=True)]


TEMPLATES = {
    "article": f"<nav><a href=x>Home</a></nav><article><h1>Short</h1>{BODY}<p>End.</p></article><footer>(c) us</footer>",
    "main": f'<header><h1>Site</h1><p>{P[0]}</p></header><main><h1>Short</h1>{BODY}<p>End.</p></main><aside><p>{P[1]}</p></aside>',
    "div": f'<div id="page"><div class="menu"><a>Home</a> <a>About</a></div><div id="content"><h1>Short</h1>{BODY}<p>End.</p></div><div class="sidebar"><p>{P[2]}</p></div></div>',
    "links": f'<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul><h1>Short</h1>{BODY}<p>End.</p>'
    '<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul>',
    "advert": f"<article><h1>Short</h1>{BODY[: len(BODY) // 2 * 0]}<div class='ad banner'><p>{P[3]} Buy.</p></div>{BODY}<div class=ad-slot>Buy</div><p>End.</p></article>",
    "comments": f"<article><h1>Short</h1>{BODY}<p>End.</p><section id='comments'><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></section></article>"
    f"<div class='comment-list'>{BODY}{BODY}</div>",
    "notice": f"<div id=cookie-consent><p>{P[4]}</p></div><div role=dialog><p>{P[5]}</p></div><article><header><h1>Short</h1><p>by me</p></header>{BODY}"
    f"<p>End.</p><form><label>Mail</label><input><button>Go</button></form><div hidden><p>{P[1]}</p></div></article>",
    "scripts": f"<script>var a = '<p>{P[0]}</p>';</script><style>p {{}}</style><noscript><p>{P[0]}</p></noscript><!-- <p>{P[1]}</p> --><article><h1>Short</h1>{BODY}<p>End.</p></article>",
    "unclosed": "<article><h1>Short</h1>" + "".join(f"<p><b>{p}<br>" for p in P) + "<p>End.</article><footer><p>x</footer>",
    "attributes": f"<article data-x='a > b' title=\"it's\"><h1 class=title>Short</h1>{BODY}<p title=don't>End.</p></article>",
    "upper": f"<ARTICLE><H1>Short</H1>{BODY.replace('<p>', '<P>')}<P>End.</ARTICLE><DIV CLASS='Footer'>x</DIV>",
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name):
    for page in (TEMPLATES[name], f"<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>\n{TEMPLATES[name]}\n</body></html>"):
        assert ht.main_text(page) == f"Short\n{WANT}\nEnd."


def test_blocks_and_references():
    text = ht.main_text("<article><p> a&amp;b\t<b>c</b>d &lt;i&gt;<br>e &#233;&eacute;&hellip;\n f</p><p> </p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table>1 < 2</article>")
    assert text == "a&b cd <i> e éé… f\none\ntwo\nx\ny\n1 < 2"


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "just words"), (3, "u", "<p>"), (3, "u", "<p>"), (4, "u", "<" * 50_000),
             (5, "u", "<p a='" * 20_000), (6, "u", "<div>" * 20_000 + "deep"), (7, "u", "<article>" + "<p>word " * 50_000), (8, "u", "<a>only a link</a>"),
             (10, "u", "<b>" * 20_000 + "</i>" * 20_000), (9, "u", "<script>" + "x" * 10_000)]
    df = spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id long, url string, html string, n_chars int, `te.xt` string")
    got = sorted((tuple(r) for r in ht.extract(df).collect()), key=repr)
    assert len(got) == len(pages)
    text = {r[0]: r[2] for r in got}
    assert text[1] == text[2] == text[3] == text[9] == text[8] == "" and text[None] == "just words" and text[6] == "deep"
    assert text[7] == "\n".join(["word"] * 50_000)
    assert all(r[3] == len(r[2]) for r in got)
    assert ht.extract(df.limit(0)).count() == 0
