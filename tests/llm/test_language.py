"""Segmentation-marginalised language models against enumeration of all segmentations."""

import math
import random
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from pagewarden.llm import queries, segment_language as own
from test_operators import EDGE, documents

VOCABULARY = ["a", "b", "ab", "ba", "abb", "▁", "▁a", "▁ab", "é"]


def segmentations(word, vocabulary):
    """All ways to cut a word into pieces; a character that is no piece stands alone, as None."""
    if not word:
        yield []
    for end in range(1, len(word) + 1):
        piece = word[:end]
        if piece in vocabulary or end == 1:
            for rest in segmentations(word[end:], vocabulary):
                yield [piece if piece in vocabulary else None, *rest]


def model(seed=0):
    rng = np.random.default_rng(seed)
    return own.Model(VOCABULARY, ["x", "y"], np.log([0.25, 0.75]),
                     own._with_unknown(rng.dirichlet(np.ones(len(VOCABULARY)), 2).T))


def probability(m, pieces, k):
    return math.prod(m.table[VOCABULARY.index(p) if p else -1, k] for p in pieces)


WORDS = ["▁" + "".join(w) for n in range(1, 6) for w in product("abcé", repeat=n)][::7] + ["▁ab" * 5 + "c"]


def test_words_are_sums_over_all_segmentations():
    m = model()
    got = m.words(WORDS, own.Lattice(VOCABULARY))
    for row, word in zip(got, WORDS):
        for k in (0, 1):
            want = sum(probability(m, s, k) for s in segmentations(word, VOCABULARY))
            assert row[k] == pytest.approx(math.log(want), rel=1e-9)


def test_long_words_go_on_where_short_ones_end(monkeypatch):
    m, words = model(1), ["▁" + "abbaécab" * n for n in (1, 2, 3)]
    long = own.Lattice(VOCABULARY)
    monkeypatch.setattr(own, "SHORT", 100)
    plain = m.words(words, long)
    monkeypatch.setattr(own, "SHORT", 3)
    assert np.allclose(m.words(words, long), plain)


def test_expected_counts():
    m = model(2)
    language, n = np.arange(len(WORDS)) % 2, np.arange(1.0, len(WORDS) + 1)
    want = np.zeros(m.table.shape)
    for word, k, times in zip(WORDS, language, n):
        ways = list(segmentations(word, VOCABULARY))
        weights = [probability(m, s, k) for s in ways]
        for way, weight in zip(ways, weights):
            for piece in way:
                want[VOCABULARY.index(piece) if piece else -1, k] += times * weight / sum(weights)
    assert np.allclose(m.expected(WORDS, language, n, own.Lattice(VOCABULARY)), want)


def test_texts_by_plain_sums():
    m, rng = model(3), random.Random(1)
    texts = [" ".join("".join(rng.choices("abAé1c", k=rng.randint(1, 5))) for _ in range(9)) for _ in range(50)]
    langs, scores = m.scorer()(texts)
    for text, lang, score in zip(texts, langs, scores):
        logs = [m.priors[k] + sum(math.log(sum(probability(m, s, k) for s in segmentations(own.START + w, VOCABULARY)))
                                  for w in own.words(text)) for k in (0, 1)]
        assert lang == "xy"[int(logs[1] > logs[0])]
        assert score == pytest.approx(1 / (1 + math.exp(-abs(logs[0] - logs[1]))))


def test_edges(spark):
    docs = documents(spark, EDGE)
    vocabulary = own.pieces(public_tokenizers.path(queries.PIECES))
    learned = own.fit(docs, vocabulary)
    rows = own.languages(docs, learned).collect()
    assert len(rows) == len(EDGE)
    for row in rows:
        text = dict((k, t) for k, t in EDGE if k is not None).get(row.doc_id, "a")
        has_letter = any(c.isalpha() for c in text or "")
        assert row.lang_pred == ("en" if has_letter else "und") or row.doc_id is None
        assert row.score == (1.0 if row.lang_pred == "en" else 0.0)
    nothing = own.fit(docs.limit(0), vocabulary)
    assert {(r.lang_pred, r.score) for r in own.languages(docs, nothing).collect()} == {("und", 0.0)}
    assert own.languages(docs.limit(0), learned).count() == 0


def test_words_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(own, "COUNTED_WORDS", 3)
    rows = [(1, "One two two"), (2, "two 3three"), (3, None), (4, "")] * 2
    got = {(r.lang, r.word): r.n for r in own.word_counts(documents(spark, rows)).collect()}
    assert got == {("en", "one"): 2, ("en", "two"): 6, ("en", "three"): 2}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op12(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
