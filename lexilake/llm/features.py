"""Hashed word and character n-gram features, shared by the two quality models."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

BITS = 18
SIZE = 1 << BITS
#: Bytes of the longest text that a model is fitted on.
LONGEST = 1 << 16

#: Character classes: lower case and non-ASCII 1, capitals 2, digits 3, blank 4, line end 5,
#: each ASCII sign its own, other controls 6.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
for _i, _c in enumerate([b for b in range(33, 127) if not chr(b).isalnum()]):
    _CLASS[_c] = 7 + _i


def _slot(x: np.ndarray, family: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (K.mix(x + K.U64(family << 58)) >> K.U64(64 - BITS)).astype(np.int64)


#: Characters of a run that are looked at in one piece.
PIECE = 1 << 18
#: Bytes in a character n-gram of the text itself.
CHARACTERS = 5
FAMILIES = 7


def grams(run: K.Run) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, documents, slots) of every n-gram, piece by piece: words; pairs of words; equality patterns of
    four successive words; n-grams of 2 to 4 character classes, with runs of letters, and of digits, drawn
    together; n-grams of ``CHARACTERS`` lower-cased bytes."""
    data = K.LOWER[run.data]
    t = K.tokens(run)
    h = K.token_hashes(data, t)
    yield 0, t.doc, _slot(h, 0)
    pair, at = K.windows(h, t, 2)
    yield 1, t.doc[at], _slot(pair, 1)
    n = len(h) - 3
    if n > 0:
        at = np.flatnonzero(t.doc[:n] == t.doc[3:])
        a, b, c, d = (h[at + k] for k in range(4))
        code = sum((x == y).astype(np.uint64) << K.U64(k) for k, (x, y) in enumerate(((a, b), (b, c), (c, d), (a, c), (b, d), (a, d))))
        yield 2, t.doc[at], _slot(code, 2)
    kind = _CLASS[run.data]
    edge = np.zeros(len(kind) + 1, bool)
    edge[run.offsets] = True
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > 3) | edge[1:-1]
    kept = np.cumsum([np.count_nonzero(keep[x:y]) for x, y in zip(run.offsets[:-1], run.offsets[1:])])
    for family, codes, ends, sizes in ((3, kind[keep], kept, (2, 3, 4)), (6, data, run.offsets[1:], (CHARACTERS,))):
        for lo in range(0, len(codes), PIECE):
            part = codes[lo : lo + PIECE + max(sizes) - 1].astype(np.uint64)
            doc = np.searchsorted(ends, np.arange(lo, lo + len(part)), "right")
            code = part
            for size in range(2, max(sizes) + 1):
                code = (code[:-1] << K.U64(8)) | part[size - 1 :]
                if size in sizes:
                    own = min(len(code), PIECE)
                    same = doc[:own] == doc[size - 1 : size - 1 + own]
                    yield family + sizes.index(size), doc[:own][same], _slot(code[:own][same], family + sizes.index(size))


def distinct(run: K.Run) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of the distinct n-grams, sorted by document."""
    held, size = [], 0
    for _, d, s in grams(run):
        held.append((d << BITS) | s)
        size += len(d)
        if size > 16 * PIECE:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
    key = np.sort(np.concatenate(held))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key >> BITS, key & (SIZE - 1)


def dots(run: K.Run, weight: np.ndarray) -> np.ndarray:
    """For each document the sum over its n-grams of weight, each worth one over the number that its document
    has in the same family."""
    n = run.hi - run.lo
    total, count = np.zeros((FAMILIES, n)), np.zeros((FAMILIES, n))
    for family, d, s in grams(run):
        total[family] += np.bincount(d, weight[s], n)
        count[family] += np.bincount(d, minlength=n)
    return (total / np.maximum(count, 1)).sum(0)


def shares(run: K.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value) of the distinct n-grams, sorted by document: the values that ``dots`` sums."""
    n = run.hi - run.lo
    count = np.zeros((FAMILIES, n))
    for family, d, _ in grams(run):
        count[family] += np.bincount(d, minlength=n)
    key, value = np.zeros(0, np.int64), np.zeros(0)
    for family, d, s in grams(run):
        key, back = np.unique(np.concatenate((key, (d << BITS) | s)), return_inverse=True)
        value = np.bincount(back, np.concatenate((value, 1 / count[family][d])), len(key))
    return key >> BITS, key & (SIZE - 1), value.astype(np.float32)


def least_ids(ids: DataFrame, limit: int) -> DataFrame:
    """(id) of the ``limit`` distinct ids of least hash. Each task keeps so many and no more, however often an id repeats."""

    def work(batches):
        best = np.zeros((2, 0), np.int64)
        for b in batches:
            rows = np.concatenate((best, np.stack([b.column(i).to_numpy() for i in (0, 1)])), 1)
            best = np.unique(rows, axis=1)[:, :limit]
        yield pa.record_batch([pa.array(x) for x in best], ["h", "id"])

    rows = ids.select(F.xxhash64("id"), F.col("id").cast("long")).mapInArrow(work, "h long, id long")
    return rows.distinct().orderBy("h", "id").limit(limit).select("id")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, where: str, limit: int, longest: int = LONGEST) -> DataFrame:
    """(id, text, y) of at most ``limit`` labelled documents that satisfy ``where`` over ``id``, those
    of least hash. Rows with a null id, label or text, and texts of more than ``longest`` bytes, are left out;
    repeated ids count once, by their smallest label and smallest text. The two limits bound what is
    broadcast and what one task fits a model on: ``limit`` texts of ``longest`` bytes, some features a word and byte."""
    some = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    some = some.where(where).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where((F.octet_length("text") <= longest) & F.col("text").isNotNull())
    return text.join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def fitted(sample: DataFrame, weighted: bool, fit: Callable):
    """What ``fit(rows, values, y)`` makes of the sample: for each row in order of id its slots, values (none if not
    ``weighted``) and label. The features are made in parallel; the fit, whose input the sample's limits bound, runs in one
    task, and only its result, a model of fixed size, comes to the driver."""

    def work(batches):
        for b in batches:
            for run in K.runs(b.column(1), PIECE):
                n = run.hi - run.lo
                if weighted:
                    d, s, v = shares(run)
                else:
                    d, s = distinct(run)
                    v = np.zeros(0, np.float32)
                cut = np.searchsorted(d, np.arange(n + 1))
                part = [slice(cut[i], cut[i + 1]) for i in range(n)]
                yield pa.record_batch([b.column(0).slice(run.lo, n), K.binary_array([s[p].astype(np.int32) for p in part]), K.binary_array([v[p] for p in part]), b.column(2).slice(run.lo, n)], ["id", "slots", "values", "y"])

    def train(batches):
        ids, slots, values, y = [], [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            slots += [np.frombuffer(x.as_py(), np.int32) for x in b.column(1)]
            values += [np.frombuffer(x.as_py(), np.float32) for x in b.column(2)]
            y += b.column(3).to_pylist()
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        model = fit([slots[i] for i in order], [values[i] for i in order], np.array(y, np.int64)[order])
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.select("id", "text", "y").mapInArrow(work, "id long, slots binary, values binary, y int")
    got = rows.repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit([], [], np.zeros(0, np.int64))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton's method on smoothed targets."""
    pos, neg = int((y == 1).sum()), int((y != 1).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        hess = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
