"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by the class log-count ratios of their columns, and a linear model
with hinge loss is fitted to the scaled, length-normalised rows by dual coordinate descent. The fit
sees a sample of at most ``ROWS`` labelled documents; scoring reads every document once, without a
shuffle, with a model of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import features

ROWS = 10_000
PARTS, PART = 5, 0
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 8
SEED = 3


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    weights: np.ndarray  # of the scaled features
    bias: float
    slope: float
    shift: float


def log_count_ratios(labels: np.ndarray, bounds: np.ndarray, columns: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of the smoothed share of each column in rows labelled 1, over its share in the others."""
    of = np.repeat(labels, np.diff(bounds))
    ratio = np.zeros(features.SIZE)
    for label, sign in ((1, 1.0), (0, -1.0)):
        counts = np.bincount(columns[of == label], minlength=features.SIZE) + smoothing
        ratio += sign * np.log(counts / counts.sum())
    ratio[np.bincount(columns, minlength=features.SIZE) == 0] = 0.0
    return ratio


def coordinate_descent(
    labels: np.ndarray, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray, ones: np.ndarray,
    cost: float = COST, epochs: int = EPOCHS, seed: int = SEED,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, its dual solved one row at a time.

    ``values`` are the features row by row, ``ones`` the value of the bias feature of each row. The
    cost of a row is inverse to the share of its label.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([max((labels == k).mean(), 1e-9) for k in (0, 1)])
    upper = cost / (2 * share[labels])
    weights, bias = np.zeros(features.SIZE), 0.0
    dual = np.zeros(len(labels))
    norms = np.add.reduceat(np.append(values**2, 0.0), bounds[:-1]) if len(labels) else np.zeros(0)
    norms = np.where(np.diff(bounds) > 0, norms, 0.0) + ones**2
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(labels)):
            at = slice(bounds[i], bounds[i + 1])
            slope = sign[i] * (weights[columns[at]] @ values[at] + bias * ones[i]) - 1.0
            new = min(max(dual[i] - slope / norms[i], 0.0), upper[i])
            step = (new - dual[i]) * sign[i]
            if step:
                dual[i] = new
                weights[columns[at]] += step * values[at]
                bias += step * ones[i]
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits the labels, by Newton's method."""
    if len(np.unique(labels)) < 2:
        return 1.0, 0.0
    wanted = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - wanted) + 1e-6 * at)
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(labels: np.ndarray, bounds: np.ndarray, columns: np.ndarray) -> Model:
    """A model of the rows; every fifth row only calibrates. Rows of one label give a constant model."""
    aside = np.arange(len(labels)) % 5 == 4
    keep = np.repeat(~aside, np.diff(bounds))
    part = np.concatenate([[0], np.cumsum(np.diff(bounds)[~aside])])
    ratios = log_count_ratios(labels[~aside], part, columns[keep])
    if len(np.unique(labels[~aside])) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(ratios, np.zeros(features.SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    values = ratios[columns]
    sums = np.concatenate([[0.0], np.cumsum(values**2)])
    ones = 1 / np.sqrt(sums[bounds[1:]] - sums[bounds[:-1]] + 1.0)
    values = values * np.repeat(ones, np.diff(bounds))
    weights, bias = coordinate_descent(labels[~aside], part, columns[keep], values[keep], ones[~aside])
    sums = np.concatenate([[0.0], np.cumsum(weights[columns] * values)])
    margins = sums[bounds[1:]] - sums[bounds[:-1]] + bias * ones
    return Model(ratios, weights, bias, *calibrate(margins[aside], labels[aside]))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Model:
    known = features.sample(labels, label, PARTS, PART, rows, SEED)
    found = features.collected(documents.select("doc_id", "text"), known, features.ngrams)
    return fit(*found[:3])


def quality(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Labels of set-aside documents are never seen. A null or empty text has no features and gets the
    score of the bias. Without usable labels every score is one half.
    """
    slim = documents.select(documents[f"`{id}`"].alias("doc_id"), documents[f"`{text}`"].alias("text"))
    model = train(slim, labels, rows=rows)
    found = features.scored(
        slim, features.ngrams, (model.weights * model.ratios).astype(np.float32), (model.ratios**2).astype(np.float32),
        model.bias, model.slope, model.shift,
    )
    return found.select(
        "doc_id",
        features.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
