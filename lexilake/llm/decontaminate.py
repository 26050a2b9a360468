"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII bytes, lower-cased. Each fixed mask selects some
of ``SPAN`` consecutive words and ignores the others, so a substituted word breaks only the
masks that look at it. The twelve masks ignore the lines of the affine plane of order three, in which every two
points lie on one line: whichever two words of a span are substituted, one mask ignores both. Hashes of masked
windows of the benchmark are joined with those of the documents; around each hit the document and the item are laid
on the hit's diagonal, and the pair counts when some stretch of at least ``min_words`` words (or the whole item, if
shorter) agrees in at least ``percent`` of its places. Items of ``least_words`` to SPAN - 1 words are compared as
wholes, by the hash of all their words; with fewer words an item is no evidence and matches nothing.

What is found: every stretch that counts and has nine words in a row with two substitutions at most. Of stretches
taken alone that is, wherever the substitutions lie, all of 9 to 16 words, and of 20 and 25 words with four and five
substitutions (counted over all placements).

Plan: one pass over the texts probes a Bloom filter of the benchmark's hashes, sized by their number, and keeps
only regions around possible hits; the region table (small) is written, its hashes are joined
with the benchmark's, the hashes of a passage that very many documents share split over tasks, and candidates are
verified in Arrow batches. Beyond the filter's greatest size a larger benchmark only lets more windows through to
the join.

Defined results: null or empty texts, ids or items that are null, and items shorter than least_words
have no hits. Repeated rows of one id give one row per (doc_id, item_id). Empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import holds, hot_keys, salted_join, slot_bits, taken_slots, written

SPAN = 9
LEAST_WORDS = 5
#: The places that each mask ignores: the twelve lines of a three by three plane whose rows are 012, 345, 678.
LINES = [tuple(3 * ((m * x + c) % 3) + x for x in range(3)) for m in range(3) for c in range(3)] + [tuple(3 * y + x for y in range(3)) for x in range(3)]
#: A hash has a slot for each factor; with 64 times as many slots as hashes one in 10^7 other hashes passes.
FACTORS = np.random.Generator(np.random.PCG64(90210)).integers(0, 2**64, 8, dtype=K.U64) | K.U64(1)
MARGIN = 64
GAP = 64


def _words(run: K.Run) -> tuple[np.ndarray, K.Tokens]:
    data = K.fold(run.data)
    t = K.tokens(K.Run(run.lo, run.hi, data, run.offsets), K.NOT_ALNUM)
    return K.token_hashes(data, t), t


def _masked(h: np.ndarray, t: K.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Masked window hashes (masks x windows) and the windows' first words."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros((len(LINES), 0), K.U64), np.zeros(0, np.int64)
    at = np.flatnonzero(t.doc[:n] == t.doc[SPAN - 1 :])
    with np.errstate(over="ignore"):
        part = [h[at + k] * K.POSITION[k] for k in range(SPAN)]
        total = sum(part[1:], part[0])
        out = np.stack([total - part[a] - part[b] - part[c] + K.U64(i + 1) for i, (a, b, c) in enumerate(LINES)])
        return K.mix(out), at


def _wholes(h: np.ndarray, t: K.Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, told apart by their number, and their first words."""
    w, at = K.windows(h, t, size)
    with np.errstate(over="ignore"):
        return K.mix(w + K.U64(1000 + size)), at


def _slots(h: np.ndarray, factor: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * factor >> K.U64(64 - bits)).astype(np.int64)


def _taken(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Indexes at which all of a hash's slots are taken (a Bloom filter; later probes look at what is left)."""
    left = np.flatnonzero(holds(table, _slots(h, FACTORS[0], bits)))
    for factor in FACTORS[1:]:
        left = left[holds(table, _slots(h[left], factor, bits))]
    return left


def _filter(bench: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the benchmark's hashes."""

    def work(batches):
        for b in batches:
            h = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.int64).view(K.U64)
            for factor in FACTORS:
                yield pa.record_batch([pa.array(_slots(h, factor, bits))], ["s"])

    return taken_slots(bench.select("hashes").mapInArrow(work, "s long"), bits)


def benchmark_hashes(items: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, size, words, hashes, places) for each item: its word hashes, and masked windows or, if it is short, the
    hash of the whole."""

    def work(batches):
        for b in batches:
            for run in K.runs(b.column(1)):
                n = run.hi - run.lo
                h, t = _words(run)
                m, at = _masked(h, t)
                words = [h[t.first[d] : t.first[d + 1]] for d in range(n)]
                of = t.doc[at] if len(at) else np.zeros(0, np.int64)
                cut = np.searchsorted(of, np.arange(n + 1))
                hashes = [m[:, cut[d] : cut[d + 1]].ravel().view(np.int64).tolist() for d in range(n)]
                place = [np.tile(at[cut[d] : cut[d + 1]] - t.first[d], len(LINES)).tolist() for d in range(n)]
                for size in range(least_words, SPAN):
                    w, at = _wholes(h, t, size)
                    for x, first in zip(w, at):
                        d = t.doc[first]
                        if t.first[d + 1] - t.first[d] == size:
                            hashes[d], place[d] = [int(x.view(np.int64))], [0]
                yield pa.record_batch([b.column(0).slice(run.lo, n), pa.array(np.diff(t.first)), K.binary_array(words), pa.array(hashes, pa.list_(pa.int64())), pa.array(place, pa.list_(pa.int64()))], ["item_id", "size", "words", "hashes", "places"])

    source = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull())
    return source.mapInArrow(work, "item_id long, size long, words binary, hashes array<long>, places array<long>")


def regions(docs: DataFrame, table: np.ndarray, bits: int, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, region, first, words, hashes, places): stretches of documents around windows whose hash slots the
    benchmark takes. sizes: the numbers of words of the benchmark's short items."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            text_id = b.column(2).to_pylist()
            for run in K.runs(b.column(1)):
                h, t = _words(run)
                m, at = _masked(h, t)
                places, found = [], []
                for row, first in [(x, at) for x in m] + [_wholes(h, t, s) for s in sizes]:
                    w = _taken(sent.value, row, bits)
                    places.append(first[w])
                    found.append(row[w])
                place, own = np.concatenate(places), np.concatenate(found)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, own = place[order], own[order]
                doc = t.doc[place]
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > GAP))))
                rows = []
                for a, z in zip(new, np.concatenate((new[1:], [len(place)]))):
                    d = doc[a]
                    lo, hi = max(t.first[d], place[a] - MARGIN), min(t.first[d + 1], place[z - 1] + SPAN + MARGIN)
                    rows.append((ids[run.lo + d], f"{text_id[run.lo + d]}:{lo - t.first[d]}", int(lo - t.first[d]), h[lo:hi].tobytes(), own[a:z].view(np.int64).tolist(), (place[a:z] - lo).tolist()))
                c = list(zip(*rows))
                yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], pa.list_(pa.int64()))], ["doc_id", "region", "first", "words", "hashes", "places"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    return source.select("i", "t", F.xxhash64("t")).mapInArrow(work, "doc_id long, region string, first long, words binary, hashes array<long>, places array<long>")


def best_stretch(same: np.ndarray, percent: int) -> tuple[int, int]:
    """First place and length of the longest stretch in which at least percent of places agree."""
    p = np.concatenate(([0], np.cumsum(np.where(same, 100 - percent, -percent))))
    order = np.argsort(p, kind="stable")
    low = np.minimum.accumulate(order)
    k = int(np.argmax(order - low))
    return int(low[k]), int(order[k] - low[k])


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_same, doc_word): for each contaminated pair the longest
    agreeing stretch, its agreeing words, and the document's word at which it starts."""
    bench = written(benchmark_hashes(items, item_col, item_text_col, least_words), "bench")
    seeds = bench.select("item_id", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("item_id", F.col("s.hashes").alias("hash"), F.col("s.places").alias("at"))
    known = bench.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n"), F.sort_array(F.collect_set(F.when((F.col("size") >= least_words) & (F.col("size") < SPAN), F.col("size")))).alias("short")).first()
    bits = slot_bits(4 * known.n)
    table = _filter(bench, bits)
    found = written(regions(docs, table, bits, known.short, id_col, text_col), "regions")
    hits = found.select("doc_id", "region", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("doc_id", "region", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    hot = hot_keys(hits.groupBy("hash").agg(F.count("*").alias("k")), "hash", "k", found.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0])
    lines = salted_join(hits, seeds, "hash", hot).select("doc_id", "region", "item_id", (F.col("place") - F.col("at")).alias("shift")).distinct()
    lines = written(lines, "lines")
    whole = found.select("doc_id", "region", "first", "words").dropDuplicates(["doc_id", "region"])
    both = lines.join(whole, ["doc_id", "region"])
    common = hot_keys(lines.groupBy("item_id").agg(F.count("*").alias("k")), "item_id", "k", lines.count())
    both = salted_join(both, bench.select("item_id", F.col("words").alias("item_words")), "item_id", common)

    def work(batches):
        for b in batches:
            rows = []
            for doc, item, shift, first, x, y in zip(*(b.column(i).to_pylist() for i in range(6))):
                x, y = np.frombuffer(x, K.U64), np.frombuffer(y, K.U64)
                lo, hi = max(0, shift), min(len(x), shift + len(y))
                same = x[lo:hi] == y[lo - shift : hi - shift]
                if len(y) < SPAN:
                    at, n = 0, len(same) if same.all() else 0
                else:
                    at, n = best_stretch(same, percent)
                if n >= min(min_words, len(y)):
                    rows.append((doc, item, n, int(same[at : at + n].sum()), first + lo + at))
            if rows:
                c = list(zip(*rows))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in c], ["doc_id", "item_id", "n_words", "n_same", "doc_word"])

    rows = both.select("doc_id", "item_id", "shift", "first", "words", "item_words").mapInArrow(work, "doc_id long, item_id long, n_words long, n_same long, doc_word long")
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_same", (-F.col("doc_word")).alias("w"))).alias("m"))
    return best.select("doc_id", "item_id", "m.n_words", "m.n_same", (-F.col("m.w")).alias("doc_word"))
