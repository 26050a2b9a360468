"""Quality classifier: naive Bayes support vectors.

Indicators of word and character n-grams are scaled by the log ratio of their smoothed class
counts; a linear hinge-loss model is fitted to the scaled, length-normalised rows by dual
coordinate descent, drawn part of the way to its mean weight, and its margin is turned into a
probability by a logistic fitted on out-of-fold margins.

The model is fitted on at most ``limit`` labelled documents (a documented bound); every document
is scored over its whole text in Arrow batches. Defined results: null or empty text scores as a
text without n-grams; without labelled rows of both classes the score is the share of label 1
(0.5 without any). Rows are independent, so repeated ids keep their rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X
from . import kernel as K

LIMIT = 4000


@dataclass
class Model:
    weight: np.ndarray | None  # of each slot: log-count ratio times hinge weight
    ratio: np.ndarray | None
    bias: float
    a: float
    b: float

    def scores(self, run: K.Run) -> np.ndarray:
        n = run.hi - run.lo
        if self.weight is None:
            return np.full(n, self.b)
        d, s = X.distinct(run)
        dot = np.bincount(d, self.weight[s], n)
        norm = np.sqrt(np.bincount(d, self.ratio[s] ** 2, n))
        return X.logistic(self.a * (dot / np.maximum(norm, 1e-9) + self.bias) + self.b)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss machine (bias as a constant feature of 1); ``cost`` bounds
    each row's dual variable."""
    w, bias = np.zeros(X.SIZE), 0.0
    alpha = np.zeros(len(y))
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _fit(rows, y, smooth: float, c: float, towards_mean: float):
    pos, neg = np.full(X.SIZE, smooth), np.full(X.SIZE, smooth)
    for s, one in zip(rows, y):
        (pos if one == 1 else neg)[s] += 1
    ratio = (np.log(pos / pos.sum()) - np.log(neg / neg.sum())).astype(np.float32)
    values = []
    for s in rows:
        v = ratio[s]
        values.append(v / np.float32(max(1e-9, math.sqrt(float((v * v).sum(dtype=np.float64))))))
    share = (y == 1).mean()
    cost = np.where(y == 1, c * 0.5 / share, c * 0.5 / (1 - share))
    w, bias = dual_descent(rows, values, np.where(y == 1, 1.0, -1.0), cost)
    w = (1 - towards_mean) * w + towards_mean * np.abs(w).mean() * np.sign(w)
    return ratio, w, bias, values


def fit(rows: list[np.ndarray], y: np.ndarray, smooth: float, c: float, towards_mean: float, folds: int) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(None, None, 0.0, 0.0, float((y == 1).mean()) if len(y) else 0.5)
    ratio, w, bias, values = _fit(rows, y, smooth, c, towards_mean)
    margin = np.array([float(w[s] @ v) + bias for s, v in zip(rows, values)])
    del values  # one fold's rows at a time
    fold = np.arange(len(y)) % folds
    if min(len(set(y[fold != k].tolist())) for k in range(folds)) == 2:
        margin = np.zeros(len(y))
        for k in range(folds):
            use = np.flatnonzero(fold != k)
            r, v, z = _fit([rows[i] for i in use], y[use], smooth, c, towards_mean)[:3]
            for i in np.flatnonzero(fold == k):
                x = r[rows[i]].astype(np.float64)
                margin[i] = float(v[rows[i]] @ x) / max(1e-9, float(np.sqrt((x * x).sum()))) + z
    a, b = X.platt(margin, y)
    return Model((w * ratio).astype(np.float32), ratio, bias, a, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", where: str = "true", limit: int = LIMIT, smooth: float = 1.0, c: float = 8.0, towards_mean: float = 0.0, folds: int = 4) -> Model:
    sample = X.labelled_sample(docs, labels, id_col, text_col, label, where, limit)
    return X.fitted(sample, False, lambda rows, _, y: fit(rows, y, smooth, c, towards_mean, folds))


def _share(docs: DataFrame, model: Model):
    """The model's arrays travel once to each executor."""
    return docs.sparkSession.sparkContext.broadcast(model)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    sent = _share(docs, model)

    def work(batches):
        for b in batches:
            for run in K.runs(b.column(1), X.PIECE):
                yield pa.record_batch([b.column(0).slice(run.lo, run.hi - run.lo), pa.array(sent.value.scores(run))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    sent = _share(docs, model)
    place = docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            for run in K.runs(b.column(place), X.PIECE):
                yield b.slice(run.lo, run.hi - run.lo).filter(pa.array(sent.value.scores(run) >= threshold))

    return docs.mapInArrow(work, docs.schema)
