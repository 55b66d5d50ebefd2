"""Naive Bayes support vectors for document quality.

Indicators of n-grams are scaled by the log ratio of their class counts; a
linear model with hinge loss is then fitted by dual coordinate descent and
mixed with its mean weight.  A logistic link fitted on the margins turns them
into scores.  n-grams run over word outlines, so that unseen words count.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.ngrams import Lookup, choose_features, labelled_sample, outline_grams, row_sums, sample_matrix, score_texts
from nightgrid.llm.text import slices

GRAM = 3
SAMPLE = 10_000  # labelled texts that the model is fitted on, at most
FEATURES = 20_000
LEAST_DOCS = 3


@dataclass(frozen=True)
class Model:
    keys: np.ndarray
    weights: np.ndarray  # of an indicator: log-count ratio times the linear weight
    bias: float
    slope: float  # of the logistic link
    shift: float

    def link(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (sums + self.bias) + self.shift, -40, 40)))


def log_count_ratio(y: np.ndarray, x: list[np.ndarray], n_features: int, smooth: float = 1.0) -> np.ndarray:
    p, q = (smooth + np.bincount(np.concatenate([np.zeros(0, np.int64), *[v for v, k in zip(x, y) if k == c]]).astype(np.int64), minlength=n_features) for c in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(y: np.ndarray, x: list[np.ndarray], ratio: np.ndarray, cost: float = 0.1, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + cost sum hinge(y, w.x), one dual variable at a time."""
    sign = np.where(y == 1, 1.0, -1.0)
    value = [ratio[v] for v in x]
    norm = np.array([v @ v + 1.0 for v in value])  # the bias is a feature of value 1
    alpha, w, b = np.zeros(len(x)), np.zeros(len(ratio)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)).tolist():
            g = sign[i] * (w[x[i]] @ value[i] + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x[i]] += step * value[i]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return w, b


def fit_link(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic link by damped Newton steps, with smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -40, 40)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-6)
        g = np.array([r @ margin, r.sum()])
        hess = np.array([[h @ (margin * margin), h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, c = a - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), c


def fit_quality(docs: DataFrame, labels: DataFrame, fold: Column, sample: int = SAMPLE, features: int = FEATURES, label: str = "quality", mixing: float = 0.25) -> Model:
    """Fit on at most `sample` labelled texts where `fold` holds.

    Without both labels there is no feature and the score is their rate, or a
    half without any row.
    """
    extract = partial(outline_grams, GRAM)
    rows = labelled_sample(docs, labels, label, fold, sample)
    keys = choose_features(rows, extract, features, LEAST_DOCS)
    y, x, _ = sample_matrix(rows, extract, keys)
    if not len(keys):
        rate = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(keys, np.zeros(0), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    ratio = log_count_ratio(y, x, len(keys))
    w, b = dual_coordinate_descent(y, x, ratio)
    w = (1 - mixing) * np.abs(w).mean() + mixing * w
    weights = ratio * w
    sums = np.array([weights[v].sum() for v in x])
    slope, shift = fit_link(sums + b, y)
    return Model(keys, weights, b, slope, shift)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in 0..1 of every whole text; empty and null texts have no features."""
    return score_texts(docs, partial(outline_grams, GRAM), model.keys, model.weights, model.link)


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted; `held_out` is a Column over doc_id.

    Null and empty texts get the score of a text without known n-grams.
    Repeated rows are scored each, and a label is learned once per row it joins.
    An empty table gives no rows; without labels of both kinds the score is the
    prior's.  FEATURES and LEAST_CHI bound the model, SAMPLE the rows it is
    fitted on.  Only the id and the text are read.
    """
    model = fit_quality(docs, labels, ~held_out, **fit)
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        model = shared.value
        look, extract = Lookup(model.keys), partial(outline_grams, GRAM)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(model.link(row_sums(look, extract, model.weights, texts)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
