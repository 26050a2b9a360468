"""Secret scans: fixed base patterns plus grammars inferred from labelled credentials.

Grammar inference: for each credential format a prefix tree of labelled examples is reduced by
merging states whose outgoing and final frequencies are statistically compatible (Hoeffding
bound, recursively over successors), in red-blue order, the most frequent state first. The result is a deterministic
probabilistic automaton. Candidates begin at every place of a run of credential characters at which an
automaton can be entered and are scored by their log-likelihood ratio against a uniform background; the
likeliest end counts. Lengths outside those that an automaton was shown have likelihood 0, but open-ended
formats have no greatest length. Spans above the bound are added to the base spans; base spans always stay.

Spans are in code points of the whole text, end exclusive. Defined results: null text counts as
empty, with no spans and the digest of the empty string. Rows are independent.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_NOT_HEX = np.ones(256, bool)
_NOT_HEX[48:58] = _NOT_HEX[97:103] = False
CANDIDATE = (string.ascii_letters + string.digits + "_+/=.-").encode()
_NOT_CANDIDATE = np.ones(256, bool)
_NOT_CANDIDATE[list(CANDIDATE)] = False
MIN_CANDIDATE = 16
#: Bits by which a format must explain a candidate better than the background.
MIN_BITS = 12.0
#: A walk that is so many bits below the background, more than five unseen transitions, is given up.
HOPELESS_BITS = 40.0
#: Formats whose parts have no greatest length: payloads, RSA signatures, longer account keys.
OPEN_ENDED = ("jwt", "stripe")
TAIL = 8

_ALNUM = string.ascii_letters + string.digits
#: Publicly documented credential formats, as literal parts and (alphabet, least,
#: most) parts.
FORMATS: dict[str, list] = {
    "github": ["ghp_", (_ALNUM, 36, 36)],
    "gitlab": ["glpat-", (_ALNUM + "_-", 20, 20)],
    "slack": ["xoxb-", (string.digits, 11, 12), "-", (string.digits, 11, 12), "-", (_ALNUM, 24, 24)],
    "stripe": ["sk_live_", (_ALNUM, 24, 34)],
    "google": ["AIza", (_ALNUM + "_-", 35, 35)],
    "npm": ["npm_", (_ALNUM, 36, 36)],
    "sendgrid": ["SG.", (_ALNUM + "_-", 22, 22), ".", (_ALNUM + "_-", 43, 43)],
    "jwt": ["eyJ", (_ALNUM + "_-", 17, 60), ".eyJ", (_ALNUM + "_-", 20, 120), ".", (_ALNUM + "_-", 43, 43)],
}


def labelled_credentials(count: int = 320, seed: int = 11) -> dict[str, list[str]]:
    """Labelled training credentials, drawn from the documented formats."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out: dict[str, list[str]] = {}
    for kind, parts in FORMATS.items():
        out[kind] = ["".join(p if isinstance(p, str) else "".join(p[0][k] for k in rng.integers(0, len(p[0]), rng.integers(p[1], p[2] + 1))) for p in parts) for _ in range(count)]
    return out


class _Tree:
    """Prefix tree with frequencies, merged in place."""

    def __init__(self, examples: list[str], alpha: float):
        self.ends, self.seen, self.next = [0], [0], [{}]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for x in examples:
            s = 0
            self.seen[0] += 1
            for c in x:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.seen)
                    self.ends.append(0)
                    self.seen.append(0)
                    self.next.append({})
                s = self.next[s][c]
                self.seen[s] += 1
            self.ends[s] += 1

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def flow(self, s: int, c: str) -> int:
        t = self.next[s].get(c)
        return 0 if t is None else self.through.get((s, c), self.seen[t])

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        done = set()
        while todo:
            a, b = todo.pop()
            if (a, b) in done or a == b:
                continue
            done.add((a, b))
            if self.differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self.differ(self.flow(a, c), self.seen[a], self.flow(b, c), self.seen[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def likeness(self, a: int, b: int) -> float:
        """How far two states' next characters, and classes of characters, agree: among several
        compatible states, which a rare state always has, the likest one is taken."""

        def shares(s: int) -> tuple[dict, dict]:
            exact, broad = {}, {}
            for c in self.next[s]:
                p = self.flow(s, c) / self.seen[s]
                exact[c] = p
                kind = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c
                broad[kind] = broad.get(kind, 0) + p
            end = self.ends[s] / self.seen[s]
            return exact | {"": end}, broad | {"": end}

        return sum(min(x[c], y[c]) for x, y in zip(shares(a), shares(b)) for c in x.keys() & y.keys())

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.seen[a] += self.seen[b]
            for c, t in self.next[b].items():
                more = self.flow(b, c)
                if c in self.next[a]:
                    self.through[a, c] = self.flow(a, c) + more
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t
                    self.through[a, c] = more

    def merged(self) -> None:
        self.through: dict[tuple[int, str], int] = {}
        red = [0]
        while True:
            known = set(red)
            blue = max(((self.flow(r, c), -r, c, t) for r in red for c, t in self.next[r].items() if t not in known), default=None)
            if blue is None:
                break
            count, parent, c, t = blue[0], -blue[1], blue[2], blue[3]
            fits = [(self.likeness(r, t), -r) for r in red if self.compatible(r, t)]
            if fits:
                r = -max(fits)[1]
                self.next[parent][c] = r
                self.through[parent, c] = count
                self.fold(r, t)
            else:
                red.append(t)
        self.red = red


@dataclass
class Automata:
    kinds: list[str]
    step: np.ndarray  # state, byte -> state
    bits: np.ndarray  # state, byte -> log2 probability minus the background's
    final: np.ndarray  # state -> log2 probability to end, minus the background's
    start: np.ndarray
    least: np.ndarray
    most: np.ndarray
    enters: np.ndarray  # kind, byte -> whether an example starts with it
    shown: np.ndarray  # kind, byte -> whether an example holds it
    tail: np.ndarray  # kind, byte -> whether it is among the last TAIL bytes of an example
    delimiter: np.ndarray  # kind, byte -> whether it is shown, but not in a tail
    sections: list[list[tuple[int, int]]]  # kind -> least and greatest lengths between delimiters; empty where their number varies
    open: np.ndarray  # kind -> whether lengths above those shown are allowed


def infer(examples: dict[str, list[str]], alpha: float = 0.02, floor: float = 1e-4, open_ended: tuple[str, ...] = OPEN_ENDED) -> Automata:
    """One automaton for each kind, stacked into common tables. An unseen transition costs the
    floor probability and stays in its state."""
    kinds = list(examples)
    step, bits, final, start = [], [], [], []
    for kind in kinds:
        tree = _Tree(examples[kind], alpha)
        tree.merged()
        number = {s: len(step) + i for i, s in enumerate(tree.red)}
        start.append(number[0])
        for s in tree.red:
            total = tree.ends[s] + sum(tree.flow(s, c) for c in tree.next[s])
            row, cost = np.full(256, number[s], np.int32), np.full(256, math.log2(floor * len(CANDIDATE)))
            for c, t in tree.next[s].items():
                row[ord(c)] = number[t]
                cost[ord(c)] = math.log2(max(floor, tree.flow(s, c) / total) * len(CANDIDATE))
            step.append(row)
            bits.append(cost)
            final.append(math.log2(max(floor, tree.ends[s] / total)))
    size = [[len(x) for x in examples[k]] for k in kinds]

    def bytes_of(part) -> np.ndarray:
        out = np.zeros((len(kinds), 256), bool)
        for i, k in enumerate(kinds):
            out[i, list({ord(c) for x in examples[k] for c in part(x)})] = True
        return out

    shown, tail, sections = bytes_of(lambda x: x), bytes_of(lambda x: x[-TAIL:]), []
    for i, k in enumerate(kinds):
        parts = [[len(y) for y in re.split("[" + re.escape("".join(map(chr, np.flatnonzero(shown[i] & ~tail[i])))) + "]", x)] if (shown[i] & ~tail[i]).any() else [len(x)] for x in examples[k]]
        sections.append([(min(y), max(y)) for y in zip(*parts)] if len({len(y) for y in parts}) == 1 else [])
    return Automata(
        kinds, np.stack(step), np.stack(bits).astype(np.float32), np.array(final, np.float32), np.array(start), np.array([min(s) for s in size]), np.array([max(s) for s in size]),
        bytes_of(lambda x: x[:1]), shown, tail, shown & ~tail, sections, np.array([k in open_ended for k in kinds]),
    )


@lru_cache(maxsize=1)
def default_automata() -> Automata:
    return infer(labelled_credentials())


def _lengths(a: Automata, k: int, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest length of a span from each start to ``stop`` at most (none where the first is above the
    second): with the delimiters and lengths of the kind's examples, or any greater lengths of an
    open-ended kind, in which a byte that no example shows ends the span."""
    if a.open[k]:
        strange = np.append(np.flatnonzero(~a.shown[k][data]), len(data))
        stop = np.minimum(stop, strange[np.searchsorted(strange, start)])
    low, high, most = np.full(len(start), a.least[k]), stop - start, np.iinfo(np.int64).max if a.open[k] else a.most[k]
    sections = a.sections[k]
    if len(sections):
        cut = np.concatenate((np.flatnonzero(a.delimiter[k][data]), np.full(len(sections) + 1, len(data))))
        first, fits, at = np.searchsorted(cut, start), np.ones(len(start), bool), start
        for i, (short, long) in enumerate(sections):
            end = np.minimum(cut[first + i], stop) if i == len(sections) - 1 else cut[first + i]
            if i == len(sections) - 1:
                low, high = np.maximum(low, at - start + short), end - start
                high = high if a.open[k] else np.minimum(high, at - start + long)
            else:
                fits &= (end < stop) & (end - at >= short) & (a.open[k] | (end - at <= long))
            at = end + 1
        high = np.where(fits, high, 0)
    return low, np.minimum(high, most)


def _walks(a: Automata, k: int, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best end of a walk from each start, at a length from ``low`` to ``high``, and its bits, -inf without one."""
    n = len(start)
    best, end = np.full(n, -np.inf, np.float32), start.copy()
    state, total, alive = np.full(n, a.start[k]), np.zeros(n, np.float32), np.ones(n, bool)
    seen = None  # at each byte, the last walk to pass it, once walks are long: state, bits, walk
    live, i = np.flatnonzero(low <= high), 0
    while len(live):
        c = data[start[live] + i]
        total[live] += a.bits[state[live], c]
        state[live] = a.step[state[live], c]
        i += 1
        bits = total[live] + a.final[state[live]]
        ok = (i >= low[live]) & (bits > best[live])
        best[live[ok]], end[live[ok]] = bits[ok], start[live[ok]] + i
        live = live[(high[live] > i) & (total[live] > -HOPELESS_BITS)]
        if a.open[k] and i >= 64 and len(live) > 1:
            # walks that meet in one state with the same end have one future: the likelier goes on, the earlier of equal ones
            if seen is None:
                seen = np.full(len(data) + 1, -1), np.zeros(len(data) + 1, np.float32), np.zeros(len(data) + 1, np.int64)
            at = start[live] + i
            other = seen[2][at]
            met = (seen[0][at] == state[live]) & (start[other] + low[other] == start[live] + low[live]) & (start[other] + high[other] == start[live] + high[live])
            wins = total[live] >= seen[1][at]
            alive[other[met & wins]] = False
            alive[live[met & ~wins]] = False
            seen[0][at], seen[1][at], seen[2][at] = state[live], total[live], live
            live = live[alive[live]]
    return end, best


def format_spans(a: Automata, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, bits) of the spans above the bound in the runs from ``start`` to ``stop``, from every place
    at which an automaton can be entered. An end goes on over the bytes of the kind's tails as far as the
    lengths allow. Of overlapping spans of one kind the likeliest stays; of different kinds a weaker one
    stays where it holds the stronger."""
    size = stop - start
    place = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    last = np.repeat(stop, size)
    found = []
    for k in range(len(a.kinds)):
        enters = a.enters[k][data[place]]
        s, t = place[enters], last[enters]
        low, high = _lengths(a, k, data, s, t)
        some = np.flatnonzero(low <= high)
        s, high = s[some], high[some]
        e, bits = _walks(a, k, data, s, low[some], high)
        for j in np.flatnonzero(bits >= MIN_BITS):
            end, most = int(e[j]), int(s[j] + high[j])
            rest = np.flatnonzero(~a.tail[k][data[end:most]])
            found.append((int(s[j]), end + int(rest[0]) if len(rest) else most, k, float(bits[j])))
    if not found:
        return []
    kept: list[tuple[int, int, int, float]] = []
    covered = np.zeros((len(a.kinds), len(data)), bool)
    first, after = np.full(len(data), len(data)), np.zeros(len(data), np.int64)  # least start and greatest end of the spans over a byte
    for x in sorted(found, key=lambda x: (-x[3], x[0])):
        part = slice(x[0], x[1])
        if covered[x[2], part].any() or first[part].min() < x[0] or after[part].max() > x[1]:
            continue
        kept.append(x)
        covered[x[2], part] = True
        first[part], after[part] = x[0], x[1]
    return kept


def find(run: K.Run, a: Automata) -> list[list[tuple[int, int, str, bool]]]:
    """For each document its spans (start, end, kind, base) in bytes of the run, base first."""
    docs = run.hi - run.lo
    out: list[list] = [[] for _ in range(docs)]
    raw = run.data.tobytes()
    low = K.LOWER[run.data].tobytes()

    def with_any(text: bytes, words) -> set[int]:
        found = set()
        for w in words:
            at = text.find(w)
            while at >= 0:
                d = int(np.searchsorted(run.offsets, at, "right")) - 1
                found.add(d)
                at = text.find(w, int(run.offsets[d + 1]) - len(w) + 1)
        return found

    for words, text, pattern, kind in ((_KEYWORDS, low, _ASSIGN, "assign"), ((b"AKIA",), raw, _ACCESS, "access")):
        for d in with_any(text, words):
            lo, hi = int(run.offsets[d]), int(run.offsets[d + 1])
            for m in pattern.finditer(raw[lo:hi]):  # a slice of its own: no match runs into the next document
                if (len(m[2]) >= 6) if kind == "assign" else (len(m[0]) >= 20):
                    out[d].append((lo + m.start(), lo + m.end(), kind, True))
    t = K.tokens(run, _NOT_HEX)
    for i in np.flatnonzero(t.end - t.start >= 24):
        out[int(t.doc[i])].append((int(t.start[i]), int(t.end[i]), "hex", True))
    t = K.tokens(run, _NOT_CANDIDATE)
    long = np.flatnonzero(t.end - t.start >= MIN_CANDIDATE)
    if len(long):
        start, stop, doc = [], [], []
        for s, e, d in zip(t.start[long].tolist(), t.end[long].tolist(), t.doc[long].tolist()):
            for m in re.finditer(rb"[^=]{%d,}" % MIN_CANDIDATE, raw[s:e]):
                start.append(s + m.start())
                stop.append(s + m.end())
                doc.append(d)
        start, stop = np.array(start, np.int64), np.array(stop, np.int64)
        for s, e, k, _ in format_spans(a, run.data, start, stop) if len(start) else ():
            out[doc[int(np.searchsorted(start, s, "right")) - 1]].append((s, e, a.kinds[k], False))
    order = {k: i for i, k in enumerate((*BASE_KINDS, *a.kinds))}
    for spans in out:
        spans.sort(key=lambda x: (x[0], order[x[2]], x[1]))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", automata: Automata | None = None) -> DataFrame:
    """(doc_id, spans: list of (kind, start, end, base)) for every row, in code points."""
    a = automata or default_automata()

    def work(batches):
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in batches:
            for run in K.runs(b.column(1)):
                rows = []
                for d, spans in enumerate(find(run, a)):
                    if spans:
                        lo, hi = run.offsets[d], run.offsets[d + 1]
                        lead = np.concatenate(([0], np.cumsum((run.data[lo:hi] & 0xC0) != 0x80)))
                        spans = [{"kind": k, "start": int(lead[s - lo]), "end": int(lead[e - lo]), "base": base} for s, e, k, base in spans]
                    rows.append(spans)
                yield pa.record_batch([b.column(0).slice(run.lo, run.hi - run.lo), pa.array(rows, kind_of)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["base"])

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]", automata: Automata | None = None) -> DataFrame:
    """The rows with every span, overlapping ones drawn together, replaced by the mark, and the
    column that holds the text's length brought up to date where there is one."""
    a = automata or default_automata()
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def work(batches):
        for b in batches:
            for run in K.runs(b.column(place)):
                part = b.slice(run.lo, run.hi - run.lo)
                found = find(run, a)
                if not any(found):
                    yield part
                    continue
                raw = run.data.tobytes()
                text = part.column(place).to_pylist()
                size = part.column(length).to_pylist() if length is not None else None
                for d, spans in enumerate(found):
                    if not spans:
                        continue
                    pieces, at, lo, hi = [], int(run.offsets[d]), int(run.offsets[d]), int(run.offsets[d + 1])
                    for s, e, _, _ in spans:
                        if s >= at:
                            pieces.append(raw[at:s] + (b"" if s == at > lo else mark.encode()))
                        at = max(at, e)
                    text[d] = (b"".join(pieces) + raw[at:hi]).decode()
                    if size is not None:
                        size[d] = len(text[d])
                columns = list(part.columns)
                columns[place] = pa.array(text, part.schema.field(place).type)
                if length is not None:
                    columns[length] = pa.array(size, part.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
