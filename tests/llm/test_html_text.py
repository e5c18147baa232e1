"""Extraction from pages with known main text."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text
from tidemark.llm.html_text import LABELLED, best_region, blocks_of, built_in_model, extract, main_text

LONG = "This is the story of a long sentence that goes on for many words, so that it counts as text of its own."


def page(body, head="<title>Shop</title>"):
    return f'<!DOCTYPE html><html lang="en"><head>{head}<style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 example.com &middot; All of it reserved and so on.</footer>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f'{NAV}<!-- ad --><div class="ad">Buy this now and get more for less than ever.</div><article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Second&nbsp;one\n  here,  {LONG}</p></article>{FOOT}', f"Title & more\n{LONG}\nSecond one here, {LONG}"),
        (f'<div class="cookie-banner"><p>We use cookies and so on, {LONG}</p></div>{NAV}<main><p>{LONG}</p><p>{LONG}</p></main><aside>Other things that you may want to read as well</aside>{FOOT}', f"{LONG}\n{LONG}"),
        (f'{NAV}<article><p>{LONG}</p><div class="ad">Sponsored: {LONG}</div><p>{LONG}</p><section id="comments"><div class="comment"><p>First! {LONG}</p></div></section></article>{FOOT}', f"{LONG}\n{LONG}"),
        (f'<header><h1>Site</h1><p>Best site of all</p></header><div class="content"><p>{LONG}</p><form action="/s"><label>Your mail</label><input name=q><button>Go</button></form><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
        (f"<div>{NAV}</div><div><div><p>{LONG}<p>{LONG} 1 < 2 &lt; 3</div></div>{FOOT}", f"{LONG}\n{LONG} 1 < 2 < 3"),
        (f'<p>{LONG}</p><div class="sidebar"><p>{LONG}</p></div><div class="comments"><p>{LONG}</p><p>{LONG}</p></div>', LONG),
        (f"<article><p title='a > b'>{LONG}</p><script>if (a < b) document.write('<p>no</p>')</script><ul><li>one<li>two</ul></article>", f"{LONG}\none\ntwo"),
    ],
)
def test_main_text(body, want):
    assert main_text(page(body)) == want


@pytest.mark.parametrize("tag", ['div style="overflow:hidden"', 'section title="hidden gems"', "div data-x='the hidden one'", "div data-to=/hidden-falls", "div data-hidden"])
def test_values_hide_nothing(tag):
    assert main_text(page(f"<article><{tag}><p>{LONG}</p></{tag.split()[0]}><p hidden>{LONG}</p></article>")) == LONG


@pytest.mark.parametrize("body", [f"<article><p>{LONG}</p></article>", f"<p>{LONG}", LONG])
def test_head_without_end(body):
    assert main_text(f"<html><head><title>Shop</title><style>p{{}}</style>\n{body}</html>") == LONG


@pytest.mark.parametrize("bad", ["", "<", "<<<>>>", "<div", "a < b", "<p>x", "<!-- open", "<script>never ends", "</p></p>", "&#0;&bogus;&amp", "<p a='unclosed>text</p>", "<" * 5000, "<div>" * 3000 + "deep"])
def test_broken_pages_do_not_fail(bad):
    assert isinstance(main_text(bad), str)


ARTICLE = f"<h1>A title of some length</h1><p>{LONG}</p><p>{LONG} {LONG}</p>"
MAIN = f"A title of some length\n{LONG}\n{LONG} {LONG}"
SIDE = '<div class="sidebar"><p>Other things that you may want to read here</p></div>'


@pytest.mark.parametrize(
    "body",
    [
        f'<body class="single has-sidebar">{NAV}<div>{ARTICLE}</div>{SIDE}{FOOT}</body>',
        f'<div class="site"><div class="site-content">{NAV}{ARTICLE}{FOOT}</div></div>',
        f'<form id="aspnetForm">{NAV}<div>{ARTICLE}</div>{FOOT}</form>',
        f'{NAV}<div class="thread">{ARTICLE}</div>{FOOT}',
        f'<div class="nav-open">{NAV}{ARTICLE}{FOOT}</div>',
        f'<div class="reviews-page">{NAV}<article class="story">{ARTICLE}</article>{FOOT}</div>',
        f'<div class="post-footer-wrapper"><article>{ARTICLE}</article></div>{FOOT}',
        f'<div class="sidebar-layout">{NAV}<div>{ARTICLE}</div>{SIDE}</div>{FOOT}',
        f'{NAV}<div class="no-sidebar main">{ARTICLE}</div>{FOOT}',
        f'<body class="cookie-banner-shown modal-closed"><p>Tagline here</p><div class="header-fixed"><div>{ARTICLE}</div></div>{FOOT}</body>',
    ],
)
def test_page_wide_elements_empty_no_page(body):
    assert main_text(f"<html><head><title>x</title></head>{body}</html>").removeprefix("Tagline here\n") == MAIN


def test_a_short_article_with_many_comments():
    comments = "".join(f'<div class="comment"><p>{LONG}</p></div>' for _ in range(12))
    assert main_text(page(f'{NAV}<article><p>{LONG}</p></article><section id="comments">{comments}</section>{FOOT}')) == LONG
    assert main_text(page(f'<form id="f">{NAV}<div class="content"><p>{LONG}</p></div><div id="comments">{comments}</div></form>')) == LONG


def test_text_is_never_lost_to_a_name():
    assert main_text(page(f'<div class="footer"><p>{LONG}</p></div>')) == LONG
    assert main_text(page(NAV)) == "" and main_text(page("")) == ""


def test_pages_of_other_makers():
    """Held-out pages: names, nesting and order differ from the labelled ones; precision and recall by words."""
    import random

    draw = random.Random(8)
    said = [0]

    def text(kind, n):
        said[0] += 1
        return " ".join(f"{kind}{said[0]}w{k}" for k in range(n))

    def some(kind, low, high):
        return text(kind, draw.randint(low, high))

    wrappers = ["", 'class="l-page"', 'class="wrap has-sidebar"', 'id="app" class="nav-closed"', 'class="container-fluid"', 'class="theme-light ads-enabled"', 'class="layout-with-comments"']
    holders = [("main", ""), ("article", ""), ("div", 'class="entry-content"'), ("div", 'id="main-content"'), ("div", 'class="c12"'), ("section", 'class="article__body"'), ("div", 'itemprop="articleBody"')]
    clutter = [lambda: f'<nav class="primary-nav"><ul>{"".join(f"<li><a>{some("x", 1, 3)}</a></li>" for _ in range(6))}</ul></nav>', lambda: f'<aside><h4>{some("x", 2, 4)}</h4><p>{some("x", 8, 25)}</p></aside>', lambda: f'<div class="widget-sidebar"><p>{some("x", 8, 25)}</p></div>', lambda: f'<div class="cookie-consent"><p>{some("x", 12, 30)}</p></div>', lambda: f'<div class="newsletter-signup"><p>{some("x", 6, 15)}</p></div>']
    tail = [lambda: f'<footer><p>{some("x", 6, 20)}</p></footer>', lambda: f'<div id="footer"><p>{some("x", 6, 20)}</p></div>', lambda: f'<section class="comments-area">{"".join(f"<div class=comment-body><p>{some("x", 10, 40)}</p></div>" for _ in range(draw.randint(1, 5)))}</section>', lambda: f'<div class="related-posts"><a>{some("x", 4, 9)}</a><a>{some("x", 4, 9)}</a></div>']
    right = found = wanted = 0
    for _ in range(300):
        tag, attrs = draw.choice(holders)
        body = "".join(draw.choice([f"<p>{some('m', 20, 90)}</p>", f"<h2>{some('m', 3, 8)}</h2><p>{some('m', 20, 60)}</p>", f"<ul><li>{some('m', 6, 20)}</li><li>{some('m', 6, 20)}</li></ul>", f"<blockquote>{some('m', 15, 40)}</blockquote>"]) for _ in range(draw.randint(3, 9)))
        inner = "".join(draw.choice(clutter)() for _ in range(draw.randint(1, 3))) + f"<{tag} {attrs}>{body}</{tag}>" + "".join(draw.choice(tail)() for _ in range(draw.randint(1, 3)))
        for _ in range(draw.randint(0, 3)):
            inner = f"<div {draw.choice(wrappers)}>{inner}</div>"
        got = main_text(page(inner)).split()
        right, found, wanted = right + sum(w[0] == "m" for w in got), found + len(got), wanted + sum(w[0] == "m" for w in inner.replace("<", " ").replace(">", " ").split() if "w" in w and w[1:2].isdigit())
    assert right / found > 0.95 and right / wanted > 0.95, (right / found, right / wanted)


def test_largest_stretch():
    assert best_region([-1, 2, -1, 3, -5, 4]) == (1, 4)
    assert best_region([]) == (0, 0) and best_region([-1, -2]) == (0, 0) and best_region([1, -1, 1]) == (0, 1)


def test_weights_follow_the_labelled_pages():
    w = built_in_model()
    assert w.base > 0 > w.tag and w.weights["main"] > 0 > max(w.weights[k] for k in ("nav", "ad", "comments", "footer", "form", "sidebar", "cookie"))
    assert all(any(b.main for b in blocks_of(p)) for p in LABELLED)


def test_table(spark):
    rows = [(1, None, "u"), (None, "", None), (2, page(f"<article><p>{LONG}</p></article>"), "u"), (2, page(f"<article><p>{LONG}</p></article>"), "u"), (3, page(f"<article>{'<p>' + LONG + '</p>'}</article>" * 3000), None)]
    frame = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in extract(frame).collect()}
    assert got[1] == "" and got[None] == "" and got[2] == LONG and got[3].count("\n") == 2999
    assert extract(frame).count() == 5 and extract(frame.limit(0)).count() == 0


def test_scan_against_all_stretches_on_the_pages_table():
    """The linear scan finds what the best of all stretches has, on every page of the table; and the text is the article's."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    model, right, found, wanted = html_text.built_in_model(), 0, 0, 0
    for page in pages:
        blocks = html_text.blocks_of(page)
        scores = [model.score(b) * b.words + model.tag * b.tags for b in blocks]
        total = [0.0]
        for x in scores:
            total.append(total[-1] + x)
        best = max([0.0, *(total[j] - total[i] for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        a, b = html_text.best_region(scores)
        assert abs(sum(scores[a:b]) - best) < 1e-9
        inside = [w for x in blocks if "article" in x.tokens and not x.tokens & {"aside", "nav", "form", "footer", "ad", "comments", "comment"} for w in x.text.split()]
        got = html_text.main_text(page).split()
        right, found, wanted = right + sum((Counter(got) & Counter(inside)).values()), found + len(got), wanted + len(inside)
    assert right / found > 0.97 and right / wanted > 0.97, (right / found, right / wanted)


def test_deep_pages_take_time_in_proportion():
    """Tags nested 20,000 deep, each with a text: no walk over all open elements for each."""
    import time

    page = "<article>" + "".join(f"<div class='c{k % 7}'><b>word" for k in range(20_000)) + "</article>"
    began = time.perf_counter()
    assert len(html_text.blocks_of(page)) == 20_000 and time.perf_counter() - began < 20
