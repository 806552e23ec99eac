"""Toxicity classifier with a counterfactual penalty.

Labelled texts that mention an identity group get a twin in which the group's terms are swapped for
another's. The logistic model is fitted to the labels, and the squared change of the margin between
a text and its twin is penalised, so a bare mention of a group cannot move the score. An L1 penalty
picks the features, which are then refitted without shrinkage. The fit sees at most ``ROWS``
labelled documents; scoring reads every document once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm import features

#: Terms that may stand for one another. Fixed values.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("old", "young"),
)
ROWS = 10_000
PARTS, PART = 4, 2
THRESHOLD = 0.3
LASSO = 0.0015
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
STEPS = 300
SEED = 9


class Swap:
    """Replaces each identity term by the next of its group."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS):
        self.next = {
            term.encode(): group[(i + 1) % len(group)].encode() for group in groups for i, term in enumerate(group)
        }
        self.terms = re.compile(rb"[A-Za-z]+")

    def __call__(self, text: bytes) -> bytes:
        return self.terms.sub(lambda m: self.next.get(m[0].lower(), m[0]), text)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _margins(bounds: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[columns])])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _descend(labels, bounds, columns, pairs, weights, bias, lasso, ridge, strength, steps):
    """Proximal gradient steps with a rate of its own for each column.

    ``pairs`` are (bounds, columns, sign) of the features in which twins differ from their originals.
    """
    n, owner = max(len(labels), 1), np.repeat(np.arange(len(labels)), np.diff(bounds))
    pair_bounds, pair_columns, pair_signs = pairs
    pair_owner = np.repeat(np.arange(len(pair_bounds) - 1), np.diff(pair_bounds))
    size = len(weights)
    history, bias_history = np.full(size, 1e-10), 1e-10
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(_margins(bounds, columns, weights) + bias, -30, 30))) - labels
        slope = np.bincount(columns, error[owner], size) / n + ridge * weights
        if len(pair_columns):
            change = np.bincount(pair_owner, pair_signs * weights[pair_columns], len(pair_bounds) - 1)
            slope += 2 * strength * np.bincount(pair_columns, pair_signs * change[pair_owner], size) / n
        history += slope**2
        bias_history += error.mean() ** 2
        rate = 0.5 / np.sqrt(history)
        weights = weights - rate * slope
        if lasso:
            weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * lasso, 0.0)
        bias -= 0.5 / np.sqrt(bias_history) * error.mean()
    return weights, bias


def fit(
    labels: np.ndarray, bounds: np.ndarray, columns: np.ndarray, twins: list[tuple[int, np.ndarray]],
    strength: float = COUNTERFACTUAL, lasso: float = LASSO,
) -> Model:
    """A model of the rows and their twins. Rows of one label give a constant model."""
    n = max(len(labels), 1)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    weights = np.zeros(features.SIZE)
    if len(np.unique(labels)) < 2:
        return Model(weights, bias)
    # columns that the L1 penalty would keep at zero from the start are left out
    pull = np.abs(np.bincount(columns, np.repeat(labels - share, np.diff(bounds)), features.SIZE)) / n
    live = pull > lasso
    number = np.cumsum(live) - 1
    used = live[columns]
    kept = np.concatenate([[0], np.cumsum(used)])[bounds]
    small = number[columns[used]]
    ends, parts, signs = [0], [], []
    for row, twin in twins:
        own = columns[bounds[row] : bounds[row + 1]]
        for only, sign in ((np.setdiff1d(twin, own), 1.0), (np.setdiff1d(own, twin), -1.0)):
            only = number[only[live[only]]]
            parts.append(only)
            signs.append(np.full(len(only), sign))
        ends.append(ends[-1] + len(parts[-1]) + len(parts[-2]))
    pairs = (
        np.array(ends), np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), np.concatenate([np.zeros(0), *signs])
    )
    size = int(live.sum())
    part, bias = _descend(labels, kept, small, pairs, np.zeros(size), bias, lasso, 0.0, strength, STEPS)
    chosen = part != 0
    inside = chosen[small]
    kept = np.concatenate([[0], np.cumsum(inside)])[kept]
    part, bias = _descend(labels, kept, small[inside], pairs, np.where(chosen, part, 0.0), bias, 0.0, RIDGE, strength, STEPS)
    weights[live] = np.where(chosen, part, 0.0)
    return Model(weights, bias)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, groups=IDENTITY_GROUPS) -> Model:
    known = features.sample(labels, label, PARTS, PART, rows, SEED)
    return fit(*features.collected(documents.select("doc_id", "text"), known, features.stems, Swap(groups)))


def toxicity(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Labels of set-aside documents are never seen. A null or empty text has no features and gets the
    score of the bias. Without usable labels every score is one half.
    """
    slim = documents.select(documents[f"`{id}`"].alias("doc_id"), documents[f"`{text}`"].alias("text"))
    model = train(slim, labels, rows=rows)
    found = features.scored(slim, features.stems, model.weights.astype(np.float32), None, model.bias, 1.0, 0.0)
    return found.select(
        "doc_id",
        features.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
