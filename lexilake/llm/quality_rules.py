"""Quality rules: counts over the whole text against fixed thresholds, then a hashed n-gram
logistic regression trained on labelled rows, calibrated to a probability, scored in Arrow
batches against a fixed threshold.

Words are runs of bytes other than space and U+0009 to U+000D. n_dup_lines counts lines (split
at U+000A) that have a word and equal an earlier line; n_repeat_words counts the words that lie
in an 8-word window found twice or more in the text. Base rule: fewer than 20 words, or over 30 %
of the words repeated. Defined results: a null text has no words and fails the base rule; without
labelled rows of both classes the model keeps everything that passes the base rule. Rows are
independent; the fit uses at most ``limit`` labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X
from . import kernel as K

LIMIT = 3000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_PROBABILITY = 0.5
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


@dataclass
class Model:
    weight: np.ndarray | None
    bias: float
    a: float
    b: float

    def scores(self, run: K.Run) -> np.ndarray:
        n = run.hi - run.lo
        if self.weight is None:
            return np.ones(n)
        return X.logistic(self.a * (X.dots(run, self.weight) + self.bias) + self.b)


def fit(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam over the slots that occur, classes weighted alike."""
    flat = np.concatenate(rows)
    used = np.flatnonzero(np.bincount(flat, minlength=X.SIZE))
    place = np.zeros(X.SIZE, np.int32)
    place[used] = np.arange(len(used))
    column, value = place[flat], np.concatenate(values).astype(np.float32)
    del flat
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    pull = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y != 1).mean()) / len(y)
    w, bias = np.zeros(len(used)), 0.0
    m, s, mb, sb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for k in range(1, steps + 1):
        p = X.logistic(np.bincount(row, w[column] * value, len(rows)) + bias)
        e = (p - (y == 1)) * pull
        g = np.bincount(column, e[row] * value, len(used)) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * e.sum(), 0.99 * sb + 0.01 * e.sum() ** 2
        up, down = 1 - 0.9**k, 1 - 0.99**k
        w -= rate * (m / up) / (np.sqrt(s / down) + 1e-6)
        bias -= rate * (mb / up) / (np.sqrt(sb / down) + 1e-6)
    out = np.zeros(X.SIZE, np.float32)
    out[used] = w
    return out, float(bias)


def calibrated(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> Model:
    """Three quarters of the sample fit the weights, the rest the calibration."""
    test = np.arange(len(y)) % 4 == 3
    if len(set(y[~test].tolist())) < 2:
        return Model(None, 0.0, 0.0, 0.0)
    use = np.flatnonzero(~test)
    w, bias = fit([rows[i] for i in use], [values[i] for i in use], y[use])
    rest = np.flatnonzero(test) if len(set(y[test].tolist())) == 2 else use
    margin = np.array([float(w[rows[i]] @ values[i]) + bias for i in rest])
    a, b = X.platt(margin, y[rest])
    return Model(w, bias, a, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", where: str = "true", limit: int = LIMIT) -> Model:
    return X.fitted(X.labelled_sample(docs, labels, id_col, text_col, label, where, limit), True, calibrated)


def base_counts(run: K.Run) -> dict[str, np.ndarray]:
    """The five counts for each document of the run."""
    n = run.hi - run.lo
    t = K.tokens(run)
    h = K.token_hashes(run.data, t)
    words = np.diff(t.first)
    lead = np.concatenate(([0], np.cumsum((run.data & 0xC0) != 0x80)))
    sign = np.concatenate(([0], np.cumsum(_SYMBOL[run.data])))
    dup, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64)
    w, at = K.windows(h, t, WINDOW)
    cut = np.searchsorted(at, t.first)
    # lines: the newline alone separates; equal lines have equal hashes
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = K.tokens(run, newline)
    line_hash = K.token_hashes(run.data, lines)
    has_word = np.searchsorted(t.start, lines.end) > np.searchsorted(t.start, lines.start)
    for d in range(n):
        own = w[cut[d] : cut[d + 1]]
        if len(own) > 1:
            s = np.sort(own)
            if (twice := s[1:][s[1:] == s[:-1]]).size:
                hit = np.flatnonzero(np.isin(own, twice))
                cover = np.zeros(words[d] + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + WINDOW, -1)
                repeat[d] = int((np.cumsum(cover)[:-1] > 0).sum())
        a, z = lines.first[d], lines.first[d + 1]
        if z - a > 1:
            own = line_hash[a:z][has_word[a:z]]
            dup[d] = len(own) - len(np.unique(own))
    chars = np.bincount(t.doc, lead[t.end] - lead[t.start], n).astype(np.int64)
    return {"n_words": words, "word_chars": chars, "n_symbols": sign[run.offsets[1:]] - sign[run.offsets[:-1]], "n_dup_lines": dup, "n_repeat_words": repeat}


def apply_rules(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, probability for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            for run in K.runs(b.column(1), X.PIECE):
                c = base_counts(run)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                p = sent.value.scores(run)
                columns = {"doc_id": b.column(0).slice(run.lo, run.hi - run.lo)} | {k: pa.array(v.astype(np.int64)) for k, v in c.items()}
                columns |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= min_probability)), "probability": pa.array(p)}
                yield pa.record_batch(list(columns.values()), list(columns))

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, schema)
