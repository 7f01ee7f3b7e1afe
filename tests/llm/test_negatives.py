"""Hard negatives against a comparison of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import hilbert_negatives as own

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, q int, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows], VECTORS)


def brute(rows):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(
                x is None or not math.isfinite(x) for x in vector):
            continue
        q = [int(max(-own.LARGEST, min(own.LARGEST, math.floor(256 * float(np.float32(x)))))) for x in vector]
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q))
    out = []
    for anchor, label, a in kept:
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, q)), i, other) for i, other, q in kept if i != anchor)
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and -50 * minus <= -100 * s[0] <= -95 * minus]
            out += [(anchor, positive, rank, i, -minus, -score) for rank, (score, i, _) in enumerate(inside[:3], 1)]
    return sorted(out)


def found(spark, rows):
    return sorted(map(tuple, own.hard_negatives(table(spark, rows)).collect()))


def clusters(seed, n, dims=6, centres=8, width=0.05):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (centres, dims))
    return [(int(i), [float(x) for x in at[i % centres] + rng.normal(0, width, dims)], int(rng.integers(0, 4)))
            for i in rng.permutation(n)]


@pytest.mark.parametrize("block,tile,section", [(512, 256, 1024), (7, 3, 2), (64, 256, 1024)])
def test_all_pairs(spark, monkeypatch, block, tile, section):
    for name, value in (("BLOCK", block), ("TILE", tile), ("SECTION_TILES", section), ("SLAB_ROWS", 40 * block)):
        monkeypatch.setattr(own, name, value)
    rows = clusters(block, 900)
    assert found(spark, rows) == brute(rows) != []


def test_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 256], i % 3) for i in range(0, 400, 5)]  # many ties
    rows += [(i, rows[3][1], 1) for i in range(401, 460)]  # one vector many times
    rows += [(50, rows[3][1], 2)] * 7 + [(100, [0.5], 1), (150, [], 1)]  # repeated anchors, short vectors
    rows += [(7, None, 1), (8, [None, 1.0], 1), (9, [math.nan] * 4, 1), (11, [math.inf, 0.0, 0.0, 0.0], 1),
             (None, [1.0] * 4, 1), (12, [1.0] * 4, None)]
    rows += [(200, [3e38, -3e38, 1.0, 0.0], 0), (201, [3e38, -2e38, 1.0, 0.0], 0), (202, [1e5, 0.0, 0.0, 0.0], 1)]
    assert found(spark, rows) == brute(rows) != []
    assert found(spark, []) == found(spark, [(50, None, 1)]) == found(spark, [(50, [1.0], 1)]) == []
    assert found(spark, [(50, [], 1), (51, [], 1), (52, [], 2)]) == [(50, 51, 1, 52, 0, 0)]


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(own, "BLOCK", 16)
    monkeypatch.setattr(own, "TILE", 4)
    demands, read = [], own.materialize

    def spy(df, name):
        df = read(df, name)
        if name == "negatives-demand":
            demands.append(df)
        if name == "negatives-blocks":
            demands.append(df)
        return df
    monkeypatch.setattr(own, "materialize", spy)
    rows = clusters(1, 3000, centres=6, width=0.01)
    got = found(spark, rows)
    assert got == brute(rows)
    blocks, positives, _ = demands
    tiles = positives.select("tile").distinct().count()
    pairs = positives.select(F.sum(F.size("blocks"))).first()[0]
    assert pairs < 0.1 * blocks.count() * tiles


def test_hilbert_order():
    side = 1 << own.BITS
    cells = np.array([(x, y) for x in range(side) for y in range(side)], np.int64)
    keys = own.hilbert_keys(cells, np.array([0, 0]), np.array([side - 1, side - 1]))
    walk = cells[np.argsort(np.array(keys))]
    assert len(set(keys)) == side * side
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_all_scores():
    rng = np.random.default_rng(4)
    anchors = rng.integers(-300, 300, (20, 8))
    for _ in range(50):
        rows = rng.integers(-300, 300, (5, 8))
        low, high = own.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
        scores = anchors @ rows.T
        assert (low <= scores.min(axis=1, keepdims=True)).all() and (scores.max(axis=1, keepdims=True) <= high).all()


@pytest.mark.parametrize("size", [1 << 8, 1 << 14, 1 << 26])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (2, 30, 64))
    want = [[sum(x * y for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
    assert own.product(a, b).tolist() == want
