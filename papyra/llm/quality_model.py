"""Quality scores by regularised quadratic discriminant analysis.

Statistics of the whole text, transformed towards normal shape, get one mean
and one shrunken covariance per class. A score is the logistic of the
difference of the two Mahalanobis log-densities (with the Cholesky factors
computed once), after a scale and shift fitted on the training rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, is_training, texts

#: Labelled rows that the fit may use, those with the smallest hash of their id.
TRAINING_ROWS = 12_000
FOLDS = 5
THRESHOLD = 0.3
#: Weight of the pooled covariance and of the diagonal in a class covariance.
POOLED, DIAGONAL = 0.1, 0.05

SYMBOLS, STOPS, SHOUTS, DIGITS = b"#*$%&|<>", b".,;:", b"!?", b"0123456789"
CAPITALS, SMALLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"

NAMES = ["words", "mean_word", "symbols", "stops", "shouts", "digits", "capitals", "distinct", "adjacent", "top_word", "line_repeats", "words_a_line", "word_spread"]


def _log_odds(x: float, n: float) -> float:
    return math.log((x + 0.5) / (n - x + 0.5)) if n >= x else math.log(x + 0.5) - math.log(0.5)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; defined for '' as well."""
    words = text.split()
    data = text.encode("utf-8", "surrogatepass")
    n, size = len(words), len(data)
    lost = lambda characters: size - len(data.translate(None, characters))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    capitals, smalls = lost(CAPITALS), lost(SMALLS)
    lengths = list(map(len, counts))
    mean = sum(lengths) / len(lengths) if lengths else 0.0
    spread = math.sqrt(max(sum(map(int.__mul__, lengths, lengths)) / len(lengths) - mean * mean, 0.0)) if lengths else 0.0
    return [
        math.log1p(n),
        math.log1p(mean),
        math.log((lost(SYMBOLS) + 0.5) / (n + 1)),
        math.log((lost(STOPS) + 0.5) / (n + 1)),
        math.log((lost(SHOUTS) + 0.5) / (n + 1)),
        math.log((lost(DIGITS) + 0.5) / (n + 1)),
        _log_odds(capitals, capitals + smalls),
        math.log((len(counts) + 0.5) / (n + 1)) if n else 0.0,
        math.log((sum(map(eq, words, words[1:])) + 0.5) / (n + 1)),
        math.log((max(counts.values(), default=0) + 0.5) / (n + 1)),
        math.log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 1)),
        math.log((n + 1) / (len(lines) + 1)),
        math.log1p(spread),
    ]


@dataclass
class QuadraticModel:
    means: np.ndarray
    factors: np.ndarray  # inverses of the lower Cholesky factors
    log_norms: np.ndarray  # log prior less half the log determinant
    scale: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, priors included."""
        out = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            out.append(self.log_norms[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self.scale * np.arcsinh(self.difference(x)) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(d, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> QuadraticModel:
    """Any training set gives a model: an absent class takes the other's shape."""
    k = len(NAMES)
    means, covs, logs = np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2)
    if len(x) == 0:
        x, y = np.zeros((2, k)), np.array([0, 1])
    pooled = np.cov(x.T, bias=True) + 1e-3 * np.eye(k)
    for c in (0, 1):
        part = x[y == c]
        n = len(part)
        means[c] = part.mean(0) if n else x.mean(0)
        own = np.cov(part.T, bias=True) if n > 1 else pooled
        keep = n / (n + k)
        own = keep * own + (1 - keep) * pooled
        own = (1 - POOLED) * own + POOLED * pooled
        covs[c] = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + 1e-6 * np.eye(k)
        logs[c] = math.log((n + 1) / (len(x) + 2))
    lower = np.linalg.cholesky(covs)
    model = QuadraticModel(means, np.linalg.inv(lower), logs - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1))
    d = np.arcsinh(model.difference(x))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridged logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * d).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        h = np.array([[(w * d * d).sum() + 0.01, (w * d).sum()], [(w * d).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    return model


def with_statistics(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The columns of ``keep`` and ``x``, the statistics of ``text``."""
    names = [c.split()[0] for c in keep.split(", ")]

    def work(batches):
        for b in batches:
            yield {n: b.column(n) for n in names} | {"x": [statistics(t) for t in b.column("text").to_pylist()]}

    return arrow_map(docs.select(*names, "text"), work, keep + ", x array<double>")


def training_labels(labels: DataFrame, column: str, rows: int, folds: int = FOLDS) -> DataFrame:
    """doc_id and y of at most ``rows`` labelled rows outside the held-out fold."""
    doc_id = F.col("doc_id").cast("long")
    chosen = labels.select(doc_id.alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & is_training(F.col("doc_id"), folds))
    return chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, folds: int = FOLDS) -> QuadraticModel:
    """The model of at most ``rows`` labelled documents outside the held-out
    fold. Null texts train as empty ones; labels that are neither 0 nor 1, or
    without an id, are left out; of a repeated label the larger counts. Ids of
    ``docs`` are taken to be unique: a repeated row trains each time."""
    chosen = training_labels(labels, "quality", rows, folds)
    # at most ``rows`` pairs of numbers: bounded, so sent to all
    joined = texts(docs).join(F.broadcast(chosen), "doc_id")
    got = with_statistics(joined, "doc_id long, y int").drop("doc_id").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(NAMES))
    return fit(x, got["y"].to_numpy(int))


def score_quality(docs: DataFrame, model: QuadraticModel, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every text.

    Null texts count as empty; the empty text has statistics and so a score.
    Repeated rows are scored each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            found = [statistics(t) for t in b.column("text").to_pylist()]
            s = sent.value.score(np.array(found, dtype=float).reshape(len(found), len(NAMES)))
            yield {"doc_id": b.column("doc_id"), "score": s, "predicted": (s >= threshold).astype("int32")}

    scored = arrow_map(texts(docs), work, "doc_id long, score double, predicted int")
    held = ~F.coalesce(is_training(F.col("doc_id"), folds), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
