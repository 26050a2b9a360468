"""Vectorised text kernel shared by the Arrow-batch operators.

Everything works on the UTF-8 bytes of an Arrow string column: a batch is cut into runs of
whole documents of about ``RUN`` bytes (a longer document forms a run of its own), and the
tokens of a run are found and hashed with numpy, never with a loop over tokens. Temporary
arrays are some ten bytes per byte of the run (more per byte only for pieces of ``CHUNK`` bytes), so memory
follows neither the batch's size nor, by much, that of one very long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Bytes of a run of documents.
RUN = 1 << 18
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=U64)  # a random word for each byte value
BASE = 0x9E3779B97F4A7C13 | 3  # 3 mod 8: powers of it differ from one another in the low bits
POSITION = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)  # odd multipliers by place in a window

#: Separator classes by byte value.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse up to ``CHUNK``, whatever the length of a text."""
    if not _powers:
        inverse = pow(BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", inverse)):
                a = np.full(CHUNK + 1, U64(base), U64)
                a[0] = 1
                _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


@dataclass
class Run:
    """Whole documents ``lo`` to ``hi`` of a batch: their bytes, and where each one ends."""

    lo: int
    hi: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, hi - lo + 1 values from 0


def runs(column: pa.Array, limit: int = RUN) -> Iterator[Run]:
    """Cut a string column into runs of whole documents. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    if not n:
        return
    _, place, content = column.buffers()
    offsets = np.frombuffer(place, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Run(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Tokens:
    start: np.ndarray  # byte positions in the run
    end: np.ndarray
    doc: np.ndarray  # index of the document within the run
    first: np.ndarray  # for each document, the index of its first token (one more at the end)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the two-byte Latin-1 capitals."""
    out = LOWER[data]
    at = np.flatnonzero(data == 0xC3) + 1
    at = at[at < len(data)]
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def tokens(run: Run, separator: np.ndarray = SPACE) -> Tokens:
    """Maximal runs of non-separator bytes; the end of a document also ends a token."""
    n, docs = len(run.data), run.hi - run.lo
    inside = ~separator[run.data]
    edge = np.zeros(n + 1, bool)  # a document starts here
    edge[run.offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, run.offsets)
    return Tokens(start, end, np.repeat(np.arange(docs), np.diff(first)), first)


def _long_token(data: np.ndarray) -> int:
    up, _ = _power_tables()
    total = 0
    for lo in range(0, len(data), CHUNK):
        part = data[lo : lo + CHUNK]
        total += int((BYTE_CODE[part] * up[: len(part)]).sum(dtype=U64)) * pow(BASE, lo, 2**64)
    return total % 2**64


def token_hashes(data: np.ndarray, t: Tokens) -> np.ndarray:
    """64-bit hashes of the tokens' bytes, by pieces of at most ``CHUNK`` bytes that end between tokens."""
    out = np.empty(len(t.start), U64)
    up, down = _power_tables()
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(out):
            first = int(t.start[lo])
            hi = int(np.searchsorted(t.end, first + CHUNK, "right"))
            if hi == lo:  # a token longer than a piece
                out[lo] = _long_token(data[first : int(t.end[lo])])
                hi = lo + 1
            else:
                piece = data[first : int(t.end[hi - 1])]
                total = np.empty(len(piece) + 1, U64)
                total[0] = 0
                np.cumsum(BYTE_CODE[piece] * up[: len(piece)], out=total[1:])
                s, e = t.start[lo:hi] - first, t.end[lo:hi] - first
                out[lo:hi] = (total[e] - total[s]) * down[s]
            lo = hi
        return mix(out + (t.end - t.start).astype(U64))


def windows(h: np.ndarray, t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` tokens within one document, and its first token's index."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = h[:n] * POSITION[0]
        for k in range(1, size):
            s += h[k : n + k] * POSITION[k]
    at = np.flatnonzero(t.doc[:n] == t.doc[size - 1 :])
    return mix(s[at]), at


def shingle_sets(run: Run, size: int, lower: bool = True) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its ``size``-word shingles; with fewer
    words the whole sequence as one; without words an empty array."""
    data = LOWER[run.data] if lower else run.data
    t = tokens(run)
    h = token_hashes(data, t)
    w, at = windows(h, t, size)
    cut = np.searchsorted(at, t.first)
    out = []
    for d in range(run.hi - run.lo):
        a, b = t.first[d], t.first[d + 1]
        if b - a >= size:
            s = np.sort(w[cut[d] : cut[d + 1]])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                whole = (h[a:b] * POSITION[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([whole ^ U64(0x5151515151515151)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def letters_flags(run: Run) -> np.ndarray:
    """Whether each document has a letter: ASCII, or any non-ASCII alphabetic character."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    docs = run.hi - run.lo
    out = np.zeros(docs, bool)
    count = np.concatenate(([0], np.cumsum(ascii_letter[run.data])))
    out[:] = count[run.offsets[1:]] > count[run.offsets[:-1]]
    for d in np.flatnonzero(~out):
        raw = run.data[run.offsets[d] : run.offsets[d + 1]]
        if len(raw) and raw.max() >= 128:
            out[d] = any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
    return out


def binary_array(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    return pa.array([p.tobytes() for p in parts], pa.binary())
