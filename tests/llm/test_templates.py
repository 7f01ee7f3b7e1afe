"""Template classes against brute force, and slots as subtrees."""

import random
from collections import Counter

import pytest

from pagewarden.llm import site_template as st


def sentence(rng, n):
    return " ".join(rng.choice("baran keden lolis mimot nuran soden talis vimot".split()) for _ in range(n))


def shell(body):
    return f"<html><body><nav><a href=/>Home</a></nav>{body}<div class=sidebar>More of us</div></body></html>"


@pytest.mark.parametrize("body,want", [
    ("<div class=post><h1>T</h1><div class=body><p>First long text.</p><div class=q>Quoted</div>"
     "<table><tr><td>cell</td></tr></table></div></div>", "T\n\nFirst long text.\n\nQuoted\n\ncell"),
    ("<div class=wrap><div class=other>Short</div><div class=body><p>A longer text.</p></div></div>", "A longer text."),
    ("<div class=wrap><a href=x>linked words only</a><div class=body><p>A longer text.</p></div></div>", "A longer text."),
    ("<p>Only</p><p>paragraphs</p>", "Only\n\nparagraphs"),
    ("", ""),
])
def test_a_slot_is_a_subtree(body, want):
    assert st.main_text(shell(body)) == want


def test_template_texts_do_not_widen_a_slot():
    body = "<div class=wrap>Printed on all pages<div class=body><p>A longer text of its own.</p></div></div>"
    constants = {st._hash(f"{here[1]}#Printed on all pages", st._SEED_TEXT) for kind, here, _, value
                 in st.texts(shell(body)) if value == "Printed on all pages"}
    assert st.main_text(shell(body), constants) == "A longer text of its own."
    assert st.main_text(shell(body)) == "Printed on all pages\n\nA longer text of its own."


def brute_classes(sources):
    """Tokens of one host's rows by their whole occurrence vectors; valid classes' elements and constant texts."""
    found = [st.page_tokens(s)[0] for s in sources]
    titles = Counter(t for f in found for t in f if t[0] == 2)
    groups = {}
    for token in {t for f in found for t in f if t[0] in (0, 1)}:
        vector = tuple(f.get(token, 0) for f in found)
        if sum(map(bool, vector)) >= st.MIN_SUPPORT * len(found):
            groups.setdefault(vector, set()).add(token)
    title = max(titles.values(), default=1)
    elements, constants = set(), set()
    for vector, members in groups.items():
        support = sum(map(bool, vector))
        if len(members) >= st.MIN_CLASS:
            elements |= {t for k, t in members if k == 0}
            if support >= st.CONSTANT_SUPPORT * len(found) and support > 2 * title:
                constants |= {t for k, t in members if k == 1}
    return elements, constants


@pytest.mark.parametrize("repeats", [1, 2, 3])
def test_classes_equal_brute_force(spark, repeats):
    """Repeated rows must not make unrelated tokens one class."""
    rng = random.Random(repeats)
    rows = []
    for i in range(24):
        parts = [f"<div class=k{j}><p>part {j}</p><b>fixed {j}</b></div>" for j in range(9) if rng.random() < 0.8]
        html = (f"<html><head><title>{sentence(rng, 3)}</title></head><body><ul><li>One</li><li>Two</li></ul>"
                f"{''.join(parts)}<p>{sentence(rng, 9)}</p></body></html>")
        rows += [(i, f"http://h/{i}", html)] * (repeats if i % 2 else 1)
    given = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    (got,) = st.templates(given.selectExpr(
        "'h' AS host", "xxhash64(cast(page_id AS string), url) AS key", "html")).collect()
    elements, constants = brute_classes([r[2] for r in rows])
    assert set(got.elements) == elements and set(got.constants) == constants and elements and constants


def extracted(spark, bodies):
    given = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)],
                                  "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in st.extract(given).collect()}


def test_the_slot_lies_between_elements_of_the_template(spark):
    """Every page has its own sections inside the content; the template's section around them is the slot."""
    rng, want, bodies = random.Random(4), {}, []
    for i in range(8):
        parts = [sentence(rng, 12 + i), sentence(rng, 6), sentence(rng, 40)]
        inner = "".join(f"<div class=part-{i}-{k}><p>{p}</p></div>" for k, p in enumerate(parts))
        bodies.append(f"<div class=top><p>Of {sentence(rng, 1)}</p></div><div class=content>{inner}</div>"
                      f"<div class=end><b>All rights</b><i>kept</i></div>")
        want[i] = "\n\n".join(parts)
    assert extracted(spark, bodies) == want


def test_tokens_out_of_order_leave_their_class(spark):
    fixed = ["<p>first notice</p>", "<h6></h6>", "<p>second notice</p>", "<i>third notice</i>", "<u>last notice</u>"]
    swapped = [fixed[2], fixed[1], fixed[0], *fixed[3:]]
    rng, bodies, words = random.Random(5), [], {}
    for i in range(9):
        words[i] = sentence(rng, 30)
        bodies.append("<article>" + "".join(swapped if i == 4 else fixed) + f"<section>{words[i]}</section></article>")
    got = extracted(spark, bodies)
    # Both notices stand elsewhere on page 4, and so does what follows them there.
    assert all("first notice" in t and "second notice" in t and "last notice" not in t for t in got.values())
    order, mass = st.page_template(f"<html><body>{bodies[0]}</body></html>", {})
    assert not order and sum(mass.values()) > len(words[0])
