"""Page extraction against a slow reader on random, badly nested pages."""

import random
import time

import pytest

from brute_html import read
from pagewarden.functions import html as ht
from pagewarden.operators import extraction as ex

PIECES = [
    "<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<section class='x'>", "</section>",
    "<ul><li>", "</li>", "<br>", "<br/>", "<img src=a.png alt='a > b'>", "</form>", "</a>",
    '<form action="/send" method="post">', "<form>", '<input name="email">',
    "<input name=q type=text />", '<textarea name="msg"></textarea>', "<input>",
    '<a href="/privacy">', "<a href='/x?a=1&amp;b=2' title=\"q>r\">", "<a name=top>", "<a href=/t>",
    "Privacy", " Terms &amp; more ", "text ", "a < b ", "personal", " data", " dados pessoais ",
    "&copy; 2024", "&nbsp;", "\n\t", "we use cookies", "<!-- accept cookies -->", "<!-- ad -->",
    '<script>var t="</p>"; if (a<b) {}</script>', '<script src="//cdn.x/y.js"></script>',
    "<style>p{margin:0}</style>", '<div id="onetrust-sdk">', '<aside class="a CookieBot">',
    "</aside>", "Cookies", "<h1>", "</h1>", "<span>", "</span>",
]


def _pages(n, seed):
    rng = random.Random(seed)
    return ["<html><body>" + "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40)))
            for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, ht.SPAN_CHUNK])
def test_random_pages_match_slow_reader(spark, monkeypatch, chunk):
    monkeypatch.setattr(ht, "SPAN_CHUNK", chunk)
    pages = _pages(400, chunk)
    df = spark.createDataFrame(
        [(i, "https://e.com/p", 200, h) for i, h in enumerate(pages)],
        "page_id bigint, url string, status int, html string")
    df = df.selectExpr("*", "CAST(NULL AS string) AS error")
    got = ex.with_elements(df).withColumns({}).selectExpr(
        "page_id", "plain_text", "links", f"{ex.form_records()} AS forms",
        f"{ex.banner_text()} OR {ex.marked_element()} AS banner").collect()
    assert len(got) == len(pages)
    for row in got:
        text, links, forms, banner = read(pages[row.page_id])
        where = pages[row.page_id]
        assert row.plain_text == text, where
        assert [(x.href, x.text) for x in row.links] == links, where
        want = [("https://e.com" + a if a else a, m, f, n) for a, m, f, n in forms]
        assert [(f.action, f.method, f.fields, f.has_nearby_privacy_notice)
                for f in row.forms] == want, where
        assert row.banner == banner, where


def test_deep_nesting_costs_little_more_than_none(spark):
    link = '<a href="/privacy">Privacy</a>'

    def seconds(html):
        df = spark.createDataFrame([(1, "https://e.com/p", 200, html)],
                                   "page_id bigint, url string, status int, html string").selectExpr(
            "*", "CAST(NULL AS string) AS error")
        best = None
        for _ in range(2):
            start = time.monotonic()
            assert len(ex.with_elements(df).select("links").first().links) == 16_000
            best = min(best or 1e9, time.monotonic() - start)
        return best
    flat = seconds("<form></form>" + f"<li>{link}</li>" * 16_000)
    for html in (f"<li>{link}" * 16_000 + "<form></form>", f"<div>{link}" * 16_000 + "<form></form>" + "</div>" * 16_000,
                 f"<li>{link}</p>" * 16_000 + "<form></form>"):
        assert seconds(html) < 3 * flat + 1


def test_tokens_lose_nothing(spark):
    pages = _pages(200, 5) + ["<div class=a", "<!-- open", "<script>x", "a<", "</ x>", "<a b='c>d"]
    df = spark.createDataFrame([(h,) for h in pages], "html string")
    for row in df.selectExpr("html", f"array_join({ht.tokens('html')}, '') AS again").collect():
        assert row.again == row.html


def test_very_long_tags_and_texts(spark):
    """No recursion, no quadratic matching on long input."""
    many = " ".join(f'data-a{i}="v{i}"' for i in range(20_000))
    page = f"<div {many}>" + "x < y " * 50_000 + "<a href=/privacy>Privacy</a>"
    df = spark.createDataFrame([(page,)], "html string")
    n = df.selectExpr(f"size({ht.tokens('html')}) AS n").first().n
    assert n == 5


def test_last_attribute_wins_and_entities(spark):
    tag = "<a HREF=/a data-x='href=9' href = \"/b?x=1&amp;y=2\" disabled id>"
    df = spark.createDataFrame([(tag,)], "t string").selectExpr(
        f"named_struct('attrs', {ht.attributes('t')}) AS e")
    row = df.selectExpr(f"{ht.attribute('e', 'href')} AS h", f"{ht.attribute('e', 'id')} AS i",
                        f"{ht.attribute('e', 'src')} AS s").first()
    assert tuple(row) == ("/b?x=1&y=2", "", None)
