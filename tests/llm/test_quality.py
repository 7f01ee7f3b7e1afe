"""The quality classifier's arithmetic, without Spark, on many label samples."""

import duckdb
import numpy as np
import pytest

from pagewarden.llm import quality_qda
from pagewarden.llm.quality_qda import FEATURES, RIDGE, SHRINKAGE

TABLES = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.sql(f"""SELECT coalesce(text, ''), quality FROM '{TABLES}/documents.parquet'
                          JOIN '{TABLES}/labels.parquet' USING (doc_id)
                          WHERE quality IN (0, 1) ORDER BY doc_id""").fetchall()
    return np.array([quality_qda.statistics(t) for t, _ in rows]), np.array([q for _, q in rows])


def fitted(x, y):
    classes = [x[y == c] for c in (0, 1)]
    model = quality_qda.from_moments([len(c) for c in classes], [c.sum(axis=0) for c in classes],
                                     np.array([c.T @ c for c in classes]))
    cells, counts = np.unique(np.stack([model.cells(x), y]), axis=1, return_counts=True)
    return quality_qda.calibrated(model, cells[0], cells[1], counts)


def test_no_sample_turns_the_score_around(labelled):
    x, y = labelled
    rng = np.random.default_rng(5)
    for _ in range(1000):
        some = rng.choice(len(x), int(np.exp(rng.uniform(np.log(100), np.log(2000)))), replace=False)
        model = fitted(x[some], y[some])
        kept = model.score(x) >= quality_qda.CUT
        assert model.slope > 0
        assert 0.75 < kept.mean() < 0.95 and kept[y == 1].mean() > 0.9  # 100 rows hold 15 of one class
        if len(some) >= 500:
            assert 0.84 < kept.mean() < 0.87 and kept[y == 1].mean() > 0.98


def test_difference_is_that_of_the_log_densities(labelled):
    x, y = labelled
    model = fitted(x, y)
    pooled = sum((y == c).sum() * np.cov(x[y == c].T, bias=True) for c in (0, 1)) / len(x)
    centre, scale = x.mean(axis=0), np.sqrt(np.diag(pooled))
    z = (x - centre) / scale
    logs = []
    for c in (0, 1):
        of = z[y == c]
        shrunk = (1 - SHRINKAGE) * np.cov(of.T, bias=True) + (SHRINKAGE + RIDGE) * np.eye(FEATURES)
        away = z - of.mean(axis=0)
        logs.append(np.log(len(of) / len(x)) - 0.5 * np.linalg.slogdet(shrunk)[1]
                    - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(shrunk), away))
    want = np.clip(logs[1] - logs[0], -quality_qda.CLIP, quality_qda.CLIP)
    assert np.allclose(model.difference(x), want, atol=1e-6)


def test_calibration_is_the_minimum():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = rng.integers(2, 200)
        x, weight = rng.uniform(-50, 50, n), rng.integers(1, 1000, n).astype(float)
        y = (rng.random(n) < 1 / (1 + np.exp(-rng.normal(0, 3) * x + rng.normal()))).astype(float)
        slope, shift = quality_qda.logistic(x, y, weight)
        loss = lambda a, b: (weight * (np.logaddexp(0, a * x + b) - y * (a * x + b))).sum() \
            + RIDGE / 2 * (a * a + b * b)
        assert slope >= 0
        for a, b in ((1e-3, 0), (0, 1e-3), (-1e-3, 0), (0, -1e-3)):
            if slope + a >= 0:
                assert loss(slope, shift) <= loss(slope + a, shift + b) * (1 + 1e-9) + 1e-9
