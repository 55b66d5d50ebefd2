"""Counterfactually regularised toxicity classifier.

Logistic regression over indicators of how often byte 5-grams occur.  Each labelled text that
mentions a group is paired with the same text with the group swapped for
another one; the squared difference of their logits is penalised, so a group's
name alone neither raises nor lowers the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.ngrams import byte_grams, choose_features, labelled_sample, sample_matrix, score_texts

GRAM = 5
SAMPLE = 10_000  # labelled texts that the model is fitted on, at most
FEATURES = 3_000
LEAST_DOCS = 3
LEVELS = (1, 2, 4)  # an indicator each for so many occurrences or more
LEAST_CHI = 20.0  # chance alone passes this for about one in 100,000 features
#: Neutral mentions; the terms of one group stand in for each other, each for the next one.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("elderly", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def swapped(texts: pa.Array, groups: tuple[tuple[str, ...], ...] = IDENTITIES) -> pa.Array:
    """Texts with every group term replaced by the next of its group; others come back empty."""
    following = {a: g[(i + 1) % len(g)] for g in groups for i, a in enumerate(g)}
    found = re.compile(r"\b(" + "|".join(map(re.escape, following)) + r")\b", re.IGNORECASE)
    out = []
    for text in texts.to_pylist():
        changed, n = found.subn(lambda m: following[m[0].lower()], text or "")
        out.append(changed if n else "")
    return pa.array(out, pa.string())


@dataclass(frozen=True)
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def fit_logistic(y: np.ndarray, x: list[np.ndarray], other: list[np.ndarray], n_features: int, swap: float, ridge: float = 3e-5, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on
    mean log loss + ridge/2 |w|^2 + swap/2 mean (w.x - w.x')^2 over the pairs."""
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    col = np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
    # only what a swap changes counts: features of one text of the pair and not of the other
    pairs = [(np.setdiff1d(x[i], v), np.setdiff1d(v, x[i])) for i, v in enumerate(other) if len(v)]
    prow = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    pcol = np.concatenate([np.zeros(0, np.int64), *[v for p in pairs for v in p]]).astype(np.int64)
    psign = np.concatenate([np.zeros(0), *[s * np.ones(len(v)) for p in pairs for s, v in zip((1, -1), p)]])
    n = len(y)
    bias = logit(np.clip(y.mean(), 0.5 / n, 1 - 0.5 / n))
    # row sums bound the curvature, so these steps cannot diverge
    size = np.array([len(v) + 1 for v in x])
    bend = np.bincount(col, weights=size[row], minlength=n_features) / (4 * n) + ridge
    if pairs:
        bend += swap / len(pairs) * np.bincount(pcol, weights=np.bincount(prow, minlength=len(pairs))[prow], minlength=n_features)
    scale, bias_step = 1 / bend, 4 / size.mean()
    w, v, b, vb = np.zeros(n_features), np.zeros(n_features), bias, bias
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(row, weights=v[col], minlength=n), -40, 40)))
        g = np.bincount(col, weights=((p - y) / n)[row], minlength=n_features) + ridge * v
        if pairs:
            gap = np.bincount(prow, weights=psign * v[pcol], minlength=len(pairs)) / len(pairs)
            g += swap * np.bincount(pcol, weights=psign * gap[prow], minlength=n_features)
        new, nb = v - scale * g, vb - bias_step * float((p - y).mean())
        v, vb = new + k / (k + 3) * (new - w), nb + k / (k + 3) * (nb - b)
        w, b = new, nb
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold: Column, swap: float = 1.0, sample: int = SAMPLE, features: int = FEATURES, label: str = "toxic", groups: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    """Fit on at most `sample` labelled texts where `fold` holds.

    Without both labels there is no feature and the score is their rate, or a
    half without any row.
    """
    extract = partial(byte_grams, GRAM)
    rows = labelled_sample(docs, labels, label, fold, sample)
    keys = choose_features(rows, extract, features, LEAST_DOCS, LEAST_CHI, LEVELS)
    y, x, other = sample_matrix(rows, extract, keys, partial(swapped, groups=groups), LEVELS)
    if not len(keys):
        rate = float(y.mean()) if len(y) else 0.5
        return Model(keys, np.zeros(0), logit(min(max(rate, 0.001), 0.999)))
    w, b = fit_logistic(y, x, other, len(keys), swap)
    return Model(keys, w, b)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in 0..1 of every whole text; empty and null texts get the bias alone."""
    bias = model.bias
    return score_texts(docs, partial(byte_grams, GRAM), model.keys, model.weights, lambda s: 1 / (1 + np.exp(-np.clip(s + bias, -40, 40))), LEVELS)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted; `held_out` is a Column over doc_id.

    Null and empty texts get the score of a text without known n-grams.
    Repeated rows are scored each, and a label is learned once per row it joins.
    An empty table gives no rows; without labels of both kinds the score is the
    prior's.  FEATURES and LEAST_CHI bound the model, SAMPLE the rows it is
    fitted on.  Only the id and the text are read.
    """
    model = fit_toxicity(docs, labels, ~held_out, **fit)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
