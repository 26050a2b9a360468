"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of ``WINDOW`` bytes; the network runs over each window in both
directions, gives a distribution over languages at every byte (``label_positions`` returns the likeliest
label of every position), and a document's probabilities
are the mean over all its bytes. It is trained by backpropagation through time on windows of at
most ``LIMIT`` labelled documents (a documented bound); every document is predicted over its
whole text. Only the bytes of the text are inputs.

Defined results: null text, or one without a letter: ``und`` with score 1. Without labelled
rows: ``und`` with score 0. Of equally likely languages the first by code point counts. A null id is
carried, and held out of no fold: its ``held_out`` is null. Rows are independent; in training an id counts once, by
its least row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .features import least_ids

WINDOW = 48
HIDDEN = 8
LIMIT = 1200
PER_DOCUMENT = 4
STEPS = 350
BATCH = 192
PAD = 256


@dataclass
class Model:
    languages: list[str]
    x: np.ndarray  # direction, byte, gates: input weights, the byte as a one-hot vector
    u: np.ndarray  # direction, hidden, gates
    b: np.ndarray  # direction, hidden: bias of the candidate's recurrent part
    out: np.ndarray  # 2 * hidden, languages
    bias: np.ndarray


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(m: Model, d: int, codes: np.ndarray, keep: bool):
    """Hidden states (steps, hidden, windows) in one direction; with ``keep`` also what the
    backward pass needs. codes: (steps, windows)."""
    n, h = HIDDEN, np.zeros((HIDDEN, codes.shape[1]), np.float32)
    table, u, b = np.ascontiguousarray(m.x[d].T), np.ascontiguousarray(m.u[d].T), m.b[d][:, None]
    states, saved = np.empty((len(codes), n, codes.shape[1]), np.float32), []
    for t in range(len(codes)):
        x = table[:, codes[t]]
        y = u @ h
        zr = _sigmoid(x[: 2 * n] + y[: 2 * n])
        z, r = zr[:n], zr[n:]
        inner = y[2 * n :] + b
        c = np.tanh(x[2 * n :] + r * inner)
        new = c + z * (h - c)
        if keep:
            saved.append((h, z, r, inner, c))
        h = new
        states[t] = h
    return states, saved


def _gru_back(m: Model, d: int, codes, saved, grad):
    n = HIDDEN
    gx, gu, gb = np.zeros_like(m.x[d]), np.zeros_like(m.u[d]), np.zeros_like(m.b[d])
    carry = np.zeros_like(grad[0])
    for t in range(len(codes) - 1, -1, -1):
        h, z, r, inner, c = saved[t]
        g = grad[t] + carry
        gc = g * (1 - z) * (1 - c * c)
        gz = g * (h - c) * z * (1 - z)
        gr = gc * inner * r * (1 - r)
        gi = gc * r
        into = np.concatenate((gz, gr, gc))
        np.add.at(gx, codes[t], into.T)
        rec = np.concatenate((gz, gr, gi))
        gu += h @ rec.T
        gb += gi.sum(1)
        carry = g * z + m.u[d] @ rec
    return gx, gu, gb


def loss_and_gradients(m: Model, codes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted cross-entropy over all positions, and its gradient by backpropagation through time. codes and
    weight: (steps, windows); label: language of each window."""
    fore, saved_f = _gru(m, 0, codes, True)
    back, saved_b = _gru(m, 1, codes[::-1], True)
    h = np.concatenate((fore, back[::-1]), 1)  # steps, 2 hidden, windows
    logit = np.einsum("thw,hk->tkw", h, m.out) + m.bias[None, :, None]
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    own = np.arange(len(label))
    loss = -float((np.log(np.maximum(p[:, label, own], 1e-30)) * weight).sum(dtype=np.float64))
    p[:, label, own] -= 1
    p *= weight[:, None, :]
    g = np.einsum("tkw,hk->thw", p, m.out)
    grads = {"out": np.einsum("thw,tkw->hk", h, p), "bias": p.sum((0, 2)), "x": np.zeros_like(m.x), "u": np.zeros_like(m.u), "b": np.zeros_like(m.b)}
    for d, codes_d, saved, part in ((0, codes, saved_f, g[:, :HIDDEN]), (1, codes[::-1], saved_b, g[::-1, HIDDEN:])):
        grads["x"][d], grads["u"][d], grads["b"][d] = _gru_back(m, d, codes_d, saved, part)
    return loss, grads


def fit(codes: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, rate: float = 0.02, seed: int = 3) -> Model:
    """codes: (windows, WINDOW) byte values, PAD after a text's end; y: language of each window.
    Loss: cross-entropy at every byte, languages weighted alike; Adam."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = len(languages)

    def init(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    m = Model(languages, init(2, 257, 3 * HIDDEN, scale=0.3), init(2, HIDDEN, 3 * HIDDEN, scale=0.35), np.zeros((2, HIDDEN), np.float32), init(2 * HIDDEN, k, scale=0.3), np.zeros(k, np.float32))
    share = np.bincount(y, minlength=k) / len(y)
    names = ("x", "u", "b", "out", "bias")
    first = {p: np.zeros_like(getattr(m, p)) for p in names}
    second = {p: np.zeros_like(getattr(m, p)) for p in names}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(y), min(BATCH, len(y)))
        c, label = codes[at].T, y[at]
        used = (c != PAD).astype(np.float32) / (share[label] * k)[None, :].astype(np.float32)
        used /= used.sum()
        _, grads = loss_and_gradients(m, c, label, used)
        norm = float(np.sqrt(sum((v * v).sum() for v in grads.values())))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for q in names:
            v = grads[q] * clip
            first[q] = 0.9 * first[q] + 0.1 * v
            second[q] = 0.99 * second[q] + 0.01 * v * v
            setattr(m, q, (getattr(m, q) - now * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return m


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: str = "true", limit: int = LIMIT) -> Model | None:
    """Fit on windows of the ``limit`` labelled documents of least hash that satisfy ``where``
    (over ``id``). The windows lie at even distances over the whole text."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    base = base.withColumn("id", F.col("id").cast("long")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    some = least_ids(base.where(where).select("id"), limit)

    def work(batches):
        for b in batches:
            for run in K.runs(b.column(1)):
                parts = []
                for d in range(run.hi - run.lo):
                    lo, hi = run.offsets[d], run.offsets[d + 1]
                    at = np.unique(np.linspace(lo, max(lo, hi - WINDOW), PER_DOCUMENT).astype(np.int64)) if hi > lo else []
                    rows = np.full((len(at), WINDOW), PAD, np.int16)
                    for i, s in enumerate(at):
                        piece = run.data[s : min(hi, s + WINDOW)]
                        rows[i, : len(piece)] = piece
                    parts.append(rows)
                yield pa.record_batch([b.column(0).slice(run.lo, run.hi - run.lo), K.binary_array(parts), b.column(2).slice(run.lo, run.hi - run.lo)], ["id", "windows", "lang"])

    # of rows that repeat an id the least counts, so that ``limit`` rows of bounded size are gathered
    rows = base.join(F.broadcast(some), "id").select("id", "text", "lang").mapInArrow(work, "id long, windows binary, lang string")
    rows = rows.groupBy("id").agg(F.min(F.struct("windows", "lang")).alias("r")).select("id", "r.*").collect()
    rows.sort(key=lambda r: r.id)
    rows = [(np.frombuffer(r.windows, np.int16).reshape(-1, WINDOW), r.lang) for r in rows if r.windows]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    y = np.concatenate([np.full(len(w), languages.index(lang)) for w, lang in rows])
    return fit(np.concatenate([w for w, _ in rows]).astype(np.int64), y, languages)


def _positions(m: Model, run: K.Run) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int], np.ndarray]]]:
    """Some windows at a time: their documents, their first bytes, whether a place is inside the text (WINDOW,
    windows), and a function from a place to its probabilities (languages, windows)."""
    size = np.diff(run.offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(run.hi - run.lo), count)
    start = run.offsets[:-1][doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(start + WINDOW, run.offsets[1:][doc])
    of, ob = np.ascontiguousarray(m.out[:HIDDEN].T), np.ascontiguousarray(m.out[HIDDEN:].T)
    for lo in range(0, len(doc), 4096):
        s, e, d = start[lo : lo + 4096], end[lo : lo + 4096], doc[lo : lo + 4096]
        at = s[None, :] + np.arange(WINDOW)[:, None]
        inside = at < e[None, :]
        codes = np.where(inside, run.data[np.minimum(at, len(run.data) - 1)].astype(np.int64), PAD)  # as bytes PAD would be 0
        fore, _ = _gru(m, 0, codes, False)
        back, _ = _gru(m, 1, codes[::-1], False)

        def at_byte(t: int) -> np.ndarray:
            p = np.exp(of @ fore[t] + ob @ back[WINDOW - 1 - t] + m.bias[:, None])
            return p / p.sum(0)

        yield d, s, inside, at_byte


def predict_run(m: Model, run: K.Run) -> np.ndarray:
    """Mean language probabilities over all bytes of each document."""
    total = np.zeros((run.hi - run.lo, len(m.languages)))
    for d, s, inside, at_byte in _positions(m, run):
        acc = np.zeros((len(m.languages), len(s)), np.float32)
        for t in range(WINDOW):
            acc += at_byte(t) * inside[t]
        np.add.at(total, d, acc.T)
    return total / np.maximum(np.diff(run.offsets), 1)[:, None]


def label_run(m: Model, run: K.Run) -> np.ndarray:
    """The likeliest language, by number, at every byte of the run."""
    out = np.zeros(len(run.data), np.int16)
    for _, s, inside, at_byte in _positions(m, run):
        for t in range(WINDOW):
            out[s[inside[t]] + t] = at_byte(t).argmax(0)[inside[t]]
    return out


def label_positions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: list of (lang, start, end)) for every row: stretches of positions of one label, in code points, end
    exclusive; a character has the label of its first byte. Null or empty text: no spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = sent.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for run in K.runs(b.column(1)):
                label, rows = label_run(m, run), []
                for d in range(run.hi - run.lo):
                    part = slice(run.offsets[d], run.offsets[d + 1])
                    own = label[part][(run.data[part] & 0xC0) != 0x80]
                    cut = np.flatnonzero(np.diff(own)) + 1 if len(own) else np.zeros(0, np.int64)
                    first = np.concatenate(([0], cut)) if len(own) else cut
                    last = np.concatenate((cut, [len(own)])) if len(own) else cut
                    rows.append([{"lang": m.languages[own[s]], "start": int(s), "end": int(e)} for s, e in zip(first, last)])
                yield pa.record_batch([b.column(0).slice(run.lo, run.hi - run.lo), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "doc_id long, spans array<struct<lang: string, start: bigint, end: bigint>>")


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = sent.value
        for b in batches:
            for run in K.runs(b.column(1)):
                letters = K.letters_flags(run)
                if m is None:
                    lang, score = ["und"] * len(letters), np.where(letters, 0.0, 1.0)
                else:
                    p = predict_run(m, run)
                    best = p.argmax(1)
                    lang = [m.languages[i] if ok else "und" for i, ok in zip(best, letters)]
                    score = np.where(letters, np.clip(p.max(1), 0, 1), 1.0)
                yield pa.record_batch([b.column(0).slice(run.lo, run.hi - run.lo), pa.array(lang), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double")
