"""Locally consistent parsing against a plain parser, and fingerprints across lengths."""

import random

import duckdb
import numpy as np
import pytest

from pagewarden.llm import phrase_fingerprint as own
from test_operators import documents, sentence

MASK = (1 << 64) - 1
M1, M2, STEP = (int(x) for x in (own._M1, own._M2, own._STEP))


def mix(x):
    x = ((x ^ (x >> 30)) * M1) & MASK
    x = ((x ^ (x >> 27)) * M2) & MASK
    return x ^ (x >> 31)


def plain_level(names):
    """One level of one text: runs, coins, phrases that start at local maxima, names."""
    runs = []
    for n in names:
        if runs and runs[-1][0] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    symbols = [n if k == 1 else mix((n + k * STEP) & MASK) for n, k in runs]
    labels = [s & 0xFFFFFFFF for s in symbols]
    bits = [32, 8, 8, 8]
    for width in bits:
        new = []
        for i, label in enumerate(labels):
            left = labels[i - 1] if i else label ^ 1
            differ = label ^ left
            place = (differ & -differ).bit_length() - 1 if differ else width
            new.append(2 * place + (bool(label >> place & 1) if differ else 0))
        labels = new
    phrases = []
    for i, symbol in enumerate(symbols):
        inner = 0 < i < len(symbols) - 1
        if i == 0 or (inner and labels[i - 1] < labels[i] > labels[i + 1]):
            phrases.append([])
        phrases[-1].append(symbol)
    return [mix(sum(mix((s * M2 + (k + 1) * STEP) & MASK) for k, s in enumerate(p)) & MASK) for p in phrases]


@pytest.mark.parametrize("seed", range(4))
def test_levels_are_those_of_a_plain_parser(seed):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(20)] + ["a", "aaaa", "ab", "aab aab", "ß😀" * 9]
    names = [[ord(c) for c in t] for t in texts]
    flat = np.array([n for t in names for n in t], np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in names])
    for _ in own.LEVEL_SLOTS:
        flat, owner = own.level(flat, owner)
        names = [plain_level(t) for t in names]
        assert flat.tolist() == [n for t in names for n in t]
        assert owner.tolist() == [i for i, t in enumerate(names) for _ in t]


def test_fingerprint_is_the_least_name_of_each_slot():
    text = sentence(random.Random(9), 80)
    slots, before, names = {}, 0, [ord(c) for c in text]
    for depth, width in enumerate(own.LEVEL_SLOTS, 1):
        names = plain_level(names)
        for n in names:
            salted = mix(n + depth & MASK)
            at = before + salted % width
            slots[at] = min(salted, slots.get(at, MASK))
        before += width
    want = "".join(f"{(slots[i] >> 40) % 0xFFFF:04x}" if i in slots else "ffff" for i in range(own.SLOTS))
    assert own.sketches(["x", text, ""])[1:] == [want, own.EMPTY]


def test_no_length_is_special():
    """Beginnings of one text that differ by six characters are about as alike at every length."""
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' "
                                      "WHERE length(text) > 600 ORDER BY doc_id LIMIT 150").fetchall()]
    means = []
    for n in range(150, 500, 6):
        means.append(np.mean([own.likeness(*own.sketches([t[:n], t[:n + 6]])) for t in texts]))
    assert min(means) > 0.85
    assert np.abs(np.diff(means)).max() < 0.05


def test_ids_beyond_floating_point(spark):
    rows = [((1 << 60) + k, f"text number {k}") for k in range(300)] + [(None, "first"), (-(1 << 62), "second")]
    got = {r.doc_id: r for r in own.edit_likeness(documents(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (key, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        new = own.edited(text, following)
        assert got[key].edited_fingerprint == own.sketches([new])[0]
