"""Quality by regularised quadratic discriminant analysis.

Transformed statistics of the whole text go into one Gaussian per class; its covariance is shrunk
towards the diagonal of the pooled one. The score is the difference of the two log
densities (Mahalanobis distances through Cholesky factors that are computed once and sent with
the model), made a probability by a logistic curve fitted to the training rows.

Moments and the calibration histogram are aggregates over all training rows; only
class sums (a few hundred numbers) and at most 2 x 1001 histogram cells reach the driver.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagewarden.llm.common import map_batches, materialize

FEATURES = 12
SHRINKAGE = 0.1
RIDGE = 1e-3
CUT = 0.3
CLIP = 50.0
STEPS = 500
_MARKS = np.frombuffer(b"#$%&*|~^<>{}[]=+_/\\@", np.uint8)


def statistics(text: str) -> list:
    """Transformed statistics of a whole text; an empty text has all its own."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    share = lambda k: float(np.arcsin(min(1.0, k) ** 0.5))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(set(words))) / np.log1p(m)),
        share(again),
        share(upper / max(1, upper + lower)),
        share(int(counts[48:58].sum()) / n),
        share(int(counts[_MARKS].sum()) / n),
        share(int(counts[33]) / n),
        share(int(counts[[44, 46, 58, 59]].sum()) / n),
        share(int(counts[32]) / n),
        share(int(counts[10]) / n),
        float(np.log1p(len(text) / m)),
        share(int(counts[128:].sum()) / n),
    ]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: list
    factors: list  # inverse Cholesky factors
    offsets: list
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1)
                for m, f, o in zip(self.means, self.factors, self.offsets)]
        return np.clip(logs[1] - logs[0], -CLIP, CLIP)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Histogram cells, a tenth wide, of the differences."""
        return np.round(self.difference(x) * 10).astype(int)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (self.slope * self.difference(x) + self.shift)))


@dataclass
class Constant:
    """Stands in where one class has too few rows for a covariance."""
    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def with_statistics(docs: DataFrame, id_column="doc_id", text="text") -> DataFrame:
    """id and the statistics (array of doubles) of every row; null counts as empty."""
    kind = dict(docs.dtypes)[id_column]
    return map_batches(docs.select(id_column, text),
                       lambda: lambda keys, texts: (keys, [statistics(t or "") for t in texts]),
                       f"`{id_column}` {kind}, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, id_column="doc_id", label="quality"):
    """Model from (id, x) and (id, label 0 or 1). Null labels and ids teach nothing."""
    rows = stats.join(labels.select(id_column, F.col(label).cast("int").alias("y")), id_column) \
        .where("y IN (0, 1)").select("x", "y")
    rows = materialize(rows, "quality-training")
    pairs = [(i, j) for i in range(FEATURES) for j in range(i + 1)]
    sums = {r["y"]: r for r in rows.groupBy("y").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(FEATURES)],
        *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()}
    n = [sums[c]["n"] if c in sums else 0 for c in (0, 1)]
    if min(n) < 2:
        return Constant(n[1] / sum(n) if sum(n) else 0.5)
    products = np.zeros((2, FEATURES, FEATURES))
    for c in (0, 1):
        for i, j in pairs:
            products[c, i, j] = products[c, j, i] = sums[c][f"p{i}_{j}"]
    model = from_moments(n, [np.array([sums[c][f"s{i}"] for i in range(FEATURES)]) for c in (0, 1)], products)

    def cells():
        return lambda xs, ys: (ys, model.cells(np.array(xs)).tolist())
    histogram = map_batches(rows, cells, "y int, cell int").groupBy("y", "cell").count().collect()
    return calibrated(model, *(np.array([r[k] for r in histogram]) for k in ("cell", "y", "count")))


def from_moments(n, sums, products) -> Model:
    """Uncalibrated model from each class's number of rows, sums and sums of products."""
    means = [sums[c] / n[c] for c in (0, 1)]
    covariances = [products[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / sum(n)
    centre = (n[0] * means[0] + n[1] * means[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    z_means = [(m - centre) / scale for m in means]
    factors, offsets = [], []
    for c in (0, 1):
        shrunk = (1 - SHRINKAGE) * covariances[c] / np.outer(scale, scale) \
            + (SHRINKAGE + RIDGE) * np.eye(FEATURES)
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log(n[c] / sum(n)) - np.log(np.diag(low)).sum()))
    return Model(centre, scale, z_means, factors, offsets)


def calibrated(model: Model, cells, labels, rows) -> Model:
    """The model with the logistic curve of a histogram: cell, label and number of rows of each."""
    model.slope, model.shift = logistic(cells / 10, labels, rows.astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Slope (never negative) and shift of the weighted logistic curve in one variable.

    The penalised loss is strictly convex: Newton steps, halved until the loss falls enough, end in its
    one minimum. Where that has a negative slope (the difference says nothing, or the reverse),
    the best curve with slope 0 is taken. Raises ArithmeticError if steps run out.
    """
    slope, shift = _minimum(np.stack([x, np.ones_like(x)], axis=1), y, weight)
    if slope < 0:
        slope, shift = 0.0, _minimum(np.ones((len(x), 1)), y, weight)[0]
    return float(slope), float(shift)


def _minimum(design: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    at = np.zeros(design.shape[1])

    def loss(at):
        z = design @ at
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * RIDGE * at @ at
    now = loss(at)
    for _ in range(STEPS):
        p = 0.5 * (1 + np.tanh(0.5 * (design @ at)))
        gradient = design.T @ (weight * (p - y)) + RIDGE * at
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + RIDGE * np.eye(len(at))
        step = np.linalg.solve(hessian, gradient)
        fall = gradient @ step
        if fall <= 1e-12 * max(1.0, now):
            return at
        size = 1.0
        while (then := loss(at - size * step)) > now - 1e-4 * size * fall:
            size /= 2
            if size < 1e-12:  # the loss is flat to the last digit
                return at
        at, now = at - size * step, then
    raise ArithmeticError("the calibration did not converge")


def score_statistics(stats: DataFrame, model, id_column="doc_id") -> DataFrame:
    kind = dict(stats.dtypes)[id_column]
    return map_batches(stats.select(id_column, "x"),
                       lambda: lambda keys, xs: (keys, model.score(np.array(xs)).tolist()),
                       f"`{id_column}` {kind}, score double")


def with_score(docs: DataFrame, model, out: str, text="text") -> DataFrame:
    """All rows and columns, and the score of the whole text as column ``out``."""
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t or "") for t in batch.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(model.score(x), pa.float64())],
                    names=[*batch.schema.names, out])
    return docs.mapInArrow(run, schema)
