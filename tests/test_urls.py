"""URL expressions against Python's urllib."""

import random
from urllib.parse import urljoin, urlparse

from pagewarden.functions import urls

GOLD = [
    ("https://example.com", "/privacy", "https://example.com/privacy", "example.com"),
    ("https://example.com/a/b", "c", "https://example.com/a/c", "example.com"),
    ("https://example.com/a/b", "../c", "https://example.com/c", "example.com"),
    ("https://e.com/a?q=1", "#", "https://e.com/a?q=1", "e.com"),
    ("https://e.com/a/b?q=1", "?x=2", "https://e.com/a/b?x=2", "e.com"),
    ("https://e.com/a", "//cdn.x/y.js", "https://cdn.x/y.js", "cdn.x"),
    ("https://e.com/a", "mailto:x@y", "mailto:x@y", ""),
    ("https://e.com/a", "javascript:void(0)", "javascript:void(0)", ""),
    ("https://e.com/a/b/", "./c/./d/../e", "https://e.com/a/b/c/e", "e.com"),
    ("https://e.com/a", "HTTP://X.com/Y", "HTTP://X.com/Y", "x.com"),
]


def _resolved(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, href string")
    return df.selectExpr("base", "href", f"{urls.resolve('base', 'href')} AS u").selectExpr(
        "base", "href", "u", f"{urls.host('u')} AS h").collect()


def test_gold_links(spark):
    rows = {(r.base, r.href): (r.u, r.h) for r in _resolved(spark, [g[:2] for g in GOLD])}
    assert rows == {(b, h): (u, host) for b, h, u, host in GOLD}


def test_random_links_resolve_like_urllib(spark):
    rng = random.Random(7)
    seg = ["a", "b.html", "..", ".", "", "c d", "é"]
    path = lambda n: "/".join(rng.choice(seg) for _ in range(rng.randint(0, n)))
    tail = lambda: rng.choice(["", "?x=1", "?a=/b/../c", "#f", "?q=1#f", "?", "#"])
    pairs = []
    for _ in range(400):
        base = f"{rng.choice(['http', 'https'])}://{rng.choice(['e.com', 'www.E.com:8080', 'u@h.pt'])}"
        base += rng.choice(["", "/" + path(3)]) + tail()
        href = rng.choice(["", "/", "//x.org/", "http://y.org/", "tel:"]) + path(4) + tail()
        if urlparse(href).path.startswith("//") or urlparse(base).path.startswith("//"):
            continue
        pairs.append((base, href))
    for r in _resolved(spark, pairs):
        assert r.u == urljoin(r.base, r.href), (r.base, r.href)
        assert r.h == (urlparse(r.u).hostname or ""), r.u


def test_names_derived_from_urls(spark):
    df = spark.createDataFrame([("https://www.exemplo.pt/p?x=1",), ("nada",)], "url string")
    got = df.selectExpr(
        f"{urls.display_domain('url')} AS d", f"{urls.site_slug('url')} AS s",
        f"{urls.website_domain('url')} AS w", f"{urls.remote_address('url', 50)} AS r",
        f"{urls.is_valid_url('url')} AS v").collect()
    assert tuple(got[0]) == ("exemplo.pt", "www_exemplo_pt", "www.exemplo.pt",
                             "https://www.exemplo.pt", True)
    assert tuple(got[1]) == ("", "site", "unknown", "://unknown", False)
