"""Near-duplicate components by MinHash with tensored banding.

Method
  1. Each document becomes the set of its distinct word shingles (64-bit hashes). Documents with
     equal sets form a class; only one member of each class goes on, so thousands of exact copies
     cost one row.
  2. Two small collections of ``side`` tuples of ``rows`` minhashes are computed. Table (i, j) is
     keyed by tuple i of the first with tuple j of the second: ``side``^2 tables from
     2 * side * rows minhashes instead of side^2 * 2 * rows.
  3. Rows (table key, class) are dealt by ranges of (key, class), so that a bucket with a third of all
     classes spreads over many tasks. Within a bucket each class is paired with the ``window`` classes
     before it, so a bucket of at most ``window`` + 1 classes has all its pairs. The members of a larger
     bucket, or of one that a range's end cuts, are also tied in a chain.
  4. Pairs are confirmed on full sets; components of the confirmed links.
  5. Ties that still join different components form clusters. An exact sieve makes them small: sets that
     are similar enough share one of their rarest shingles (a prefix of each set, in any one order), so
     only classes that do stay tied, and texts that have no more in common than a template fall apart.
  6. In what is left of a cluster every class outside its largest component is compared with all classes
     of the cluster, block against block: a task holds at most some ``BLOCK`` sets of either side and
     counts common shingles by an index, so no pairs are listed. No pair that shares a bucket is left
     undecided unless both are in one component already, where its link cannot change the result.

Chance that a pair of similarity s shares no bucket: below 2 * (1 - s^rows)^side, which for the
defaults is 8e-4 at s = 0.8 and 6e-5 at 0.85. Chance that one does: at most (side * s^rows)^2, which is
2e-6 at 0.05 and 8e-3 at 0.2.

Defined results: null or wordless text: 0 shingles, alone in its component, kept. Null id: its
component is null, kept. Rows that repeat an id are one document: they share a component, which holds
what any of their texts is linked with, and each keeps its own text's size. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import components, dropped, holds, hot_keys, salted_join, slot_bits, slot_of, taken_slots, written

#: Least and greatest number of sets in a block; in between a cluster has some PARTS blocks. Every class is copied
#: once for each block that it meets.
LEAST_BLOCK, BLOCK, PARTS = 64, 128, 8
#: Slots in which the sieve counts shingles: 2^SIEVE_BITS counts travel to the executors.
SIEVE_BITS = 20
PAIR, TIE, HEAD, TAIL = 0, 1, 2, 3
_rng = np.random.Generator(np.random.PCG64(77001))
_MULT = _rng.integers(0, 2**64, 256, dtype=K.U64) | K.U64(1)
_ADD = _rng.integers(0, 2**64, 256, dtype=K.U64)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two words of digest for each (non-empty) set."""
    flat, cut = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(K.mix(flat ^ x), cut) for x in (K.U64(0), K.U64(0xA5A5A5A5A5A5A5A5))])


def _signatures(sets: list[np.ndarray], rows: int, side: int) -> np.ndarray:
    """Tuple hashes, one row of 2 * side for each (non-empty) set."""
    out = np.empty((len(sets), 2 * side), K.U64)
    flat = np.concatenate(sets)
    cut = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    with np.errstate(over="ignore"):
        for t in range(2 * side):
            key = np.full(len(sets), K.U64(t + 1), K.U64)
            for r in range(rows):
                f = t * rows + r
                x = flat * _MULT[f] + _ADD[f]
                x ^= x >> K.U64(32)
                x *= _MULT[f]
                key = key * K.U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, cut)
            out[:, t] = K.mix(key)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, rows: int, side: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, d1, d2, sig): the set's size, a 128-bit digest of it, tuple hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in K.runs(b.column(2)):
                sets = K.shingle_sets(run, words)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                d = np.zeros((2, len(sets)), K.U64)
                sig: list[bytes | None] = [None] * len(sets)
                if len(full):
                    some = [sets[i] for i in full]
                    d[:, full] = _digests(some)
                    for i, s in zip(full, _signatures(some, rows, side)):
                        sig[i] = s.tobytes()
                own = [b.column(i).slice(run.lo, run.hi - run.lo) for i in (0, 1)]
                yield pa.record_batch([*own, pa.array(size), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text).mapInArrow(work, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def _bucket_rows(classes: DataFrame, side: int) -> DataFrame:
    """(key, rep, n): a row for each class and table."""

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), K.U64).reshape(-1, 2 * side)
                rep = part.column(0).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    table = np.arange(side * side, dtype=K.U64).reshape(side, side)
                    key = K.mix(sig[:, :side, None] * K.U64(0xD6E8FEB86659FD93) + sig[:, None, side:] + table).reshape(len(rep), -1)
                n = side * side
                yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(rep, n)), pa.array(np.repeat(part.column(1).to_numpy(), n))], ["key", "rep", "n"])

    return classes.select("rep", "n", "sig").mapInArrow(work, "key long, rep long, n long")


def _near_pairs(buckets: DataFrame, window: int, percent: int) -> DataFrame:
    """Reads buckets in order and emits (kind, a, b): PAIR for pairs of the sliding window whose sizes
    allow a link; TIE for neighbours in a bucket larger than the window and in the first and the last
    bucket of a range, which other ranges may hold more of; HEAD and TAIL, with the key as a, for
    the ends of those two. Keeps ``window`` + 1 rows between batches, whatever a bucket's size."""

    def rows(kind, p):
        p = np.unique(p, axis=0)
        return pa.record_batch([pa.array(np.full(len(p), kind, np.int32)), pa.array(p[:, 0]), pa.array(p[:, 1])], ["kind", "a", "b"])

    def work(batches):
        kept = np.zeros((3, 0), np.int64)  # key, rep, n of the tail of the last group
        shift, opening = 0, None  # rank of the first kept row in its group; the range's first key
        for b in batches:
            if not b.num_rows:
                continue
            key, rep, n = (np.concatenate((kept[i], b.column(i).to_numpy())) for i in range(3))
            old = kept.shape[1]
            new_group = np.empty(len(key), bool)
            new_group[0] = True
            np.not_equal(key[1:], key[:-1], out=new_group[1:])
            group = np.cumsum(new_group) - 1
            start = np.flatnonzero(new_group)
            rank = np.arange(len(key)) - start[group]
            if old:
                rank[group == 0] += shift
            last = np.concatenate((start[1:], [len(key)])) - 1
            if opening is None:
                opening = key[0]
                yield rows(HEAD, np.array([[key[0], rep[0]]]))
            pairs = []
            for k in range(1, window + 1):
                if len(key) <= k:
                    break
                at = np.flatnonzero(key[k:] == key[:-k]) + k
                at = at[at >= old]
                if not len(at):
                    break
                small, large = np.minimum(n[at], n[at - k]), np.maximum(n[at], n[at - k])
                at = at[100 * small >= percent * large]
                pairs.append(np.stack((np.minimum(rep[at], rep[at - k]), np.maximum(rep[at], rep[at - k])), 1))
            if pairs and (p := np.concatenate(pairs)).size:
                yield rows(PAIR, p)
            big = (rank[last] > window) | (key[start] == opening)
            told = old and (shift + old - 1 > window or key[0] == opening)  # the kept rows are tied already
            member = np.flatnonzero(big[group] & (rank > 0))
            member = member[member >= (old if told else 0)]
            if len(member):
                yield rows(TIE, np.stack((rep[member - 1], rep[member]), 1))
            tail = max(start[-1], len(key) - window - 1)
            kept, shift = np.stack((key[tail:], rep[tail:], n[tail:])), int(rank[tail])
        if kept.shape[1]:
            key, rep = kept[0], kept[1]
            if shift + len(rep) - 1 <= window and len(rep) > 1 and key[0] != opening:
                yield rows(TIE, np.stack((rep[:-1], rep[1:]), 1))
            yield rows(TAIL, np.array([[key[-1], rep[-1]]]))

    return buckets.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep").mapInArrow(work, "kind int, a long, b long")


def _ties(found: DataFrame) -> DataFrame:
    """(a, b) of neighbours in large buckets, also where the end of a range lies between them. A range has two
    ends, so the window runs over two rows a task."""
    ends = found.where(F.col("kind") >= HEAD).withColumn("before", F.lag(F.struct("kind", "b")).over(Window.partitionBy("a").orderBy("b", "kind")))
    over = ends.where((F.col("kind") == HEAD) & (F.col("before.kind") == TAIL)).select(F.col("before.b").alias("a"), "b")
    return found.where(F.col("kind") == TIE).select("a", "b").unionByName(over).where("a != b").distinct()


def shingle_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(rep, shingles) of the classes ``wanted`` (rep, id, d1), each by a document that has the class's set. A
    slot filter, sized by the number of classes, drops most other documents before the join, so texts
    without candidates are not moved."""
    bits = slot_bits(wanted.count())
    sent = docs.sparkSession.sparkContext.broadcast(taken_slots(wanted.select(slot_of(F.xxhash64("id"), bits).alias("s")), bits))

    def work(batches):
        for b in batches:
            b = b.filter(pa.array(holds(sent.value, b.column(2).to_numpy(zero_copy_only=False))))
            for run in K.runs(b.column(1)):
                sets = K.shingle_sets(run, words)
                d = np.zeros(len(sets), K.U64)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    d[full] = _digests([sets[i] for i in full])[0]
                yield pa.record_batch([b.column(0).slice(run.lo, run.hi - run.lo), pa.array(d.view(np.int64)), K.binary_array(sets)], ["id", "d1", "shingles"])

    some = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    some = some.select("i", "t", slot_of(F.xxhash64("i"), bits).alias("s"))
    sets = some.mapInArrow(work, "id long, d1 long, shingles binary").join(wanted, ["id", "d1"])
    # rows that repeat an id and its set give one row; partial aggregation sees to most of them
    return sets.select("rep", "shingles").dropDuplicates(["rep"])


def classes_of(docs: DataFrame, id_col: str, text_col: str, words: int, rows: int, side: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: of rows (doc_id, text_hash, n_shingles, d1, d2, sig), and of classes (rep, d1, d2, id, first, n,
    k, sig): a number, the digests, the least id, the least (id, text), the set's size, the number of rows. Wordless
    texts are equal only to themselves. Rows without an id are in no class."""
    alone = F.col("n_shingles") == 0
    sig = signatures(docs, id_col, text_col, words, rows, side)
    sig = written(sig.withColumn("d1", F.when(alone, F.xxhash64("doc_id", "text_hash")).otherwise(F.col("d1"))), "signatures")
    least = (F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = sig.where("doc_id IS NOT NULL").groupBy("d1", "d2").agg(*least, F.first("n_shingles").alias("n"), F.count("*").alias("k"), F.first("sig").alias("sig"))
    return sig, written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    wanted = written(pairs.selectExpr("explode(array(a, b)) AS rep").distinct().join(classes.select("rep", "id", "d1"), "rep"), "wanted")
    sets = shingle_table(docs, wanted, id_col, text_col, words)
    both = pairs.join(sets.selectExpr("rep AS b", "shingles AS sb"), "b").join(sets.selectExpr("rep AS a", "shingles AS sa"), "a")

    def work(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), K.U64), np.frombuffer(y.as_buffer(), K.U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                z = np.sort(np.concatenate((x, y)))
                common = int((z[1:] == z[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield b.filter(pa.array(ok)).select([0, 1])

    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long").distinct()


def _clusters(ties: DataFrame, group: DataFrame) -> DataFrame | None:
    """(rep, comp, cluster) of the classes in clusters that span several components; None without any."""
    def named(t, x):
        g = group.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_comp"))
        return t.join(g, t[x] == g[f"{x}_node"], "left").withColumn(x, F.coalesce(f"{x}_comp", x)).select("a", "b")

    open_ties = written(named(named(ties, "a"), "b").where("a != b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "ties")
    if not open_ties.head(1):
        return None
    cluster = components(open_ties).selectExpr("node AS comp", "component AS cluster")
    inside = group.selectExpr("node AS rep", "component AS comp")
    hot = hot_keys(inside.groupBy("comp").agg(F.count("*").alias("k")), "comp", "k", inside.count())
    linked = salted_join(inside, cluster, "comp", hot).select("rep", "comp", "cluster")
    single = cluster.join(group.select("node"), cluster.comp == group.node, "left_anti").selectExpr("comp AS rep", "comp", "cluster")
    return written(linked.unionByName(single), "members")


def _sieve(sets: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) between classes of a cluster that share a shingle of their prefixes. In any one order of all
    shingles, two sets whose intersection is ``percent`` of their union share one of the first
    n - ceil(n * percent / 100) + 1 of each. Here rare ones come first, by counts in 2^SIEVE_BITS slots: shingles that
    share a slot only make the order less sharp, never wrong. ``sets``: (cluster, rep, shingles)."""

    def keys(cluster, shingles):
        return K.mix(shingles ^ K.mix(np.array([cluster], np.int64).view(K.U64)))

    def slots(key):
        return (key >> K.U64(64 - SIEVE_BITS)).astype(np.int64)

    def count(batches):
        for b in batches:
            with np.errstate(over="ignore"):
                per = [slots(keys(c, np.frombuffer(s.as_buffer(), K.U64))) for c, s in zip(b.column(0).to_pylist(), b.column(1))]
            if per:
                slot, n = np.unique(np.concatenate(per), return_counts=True)
                yield pa.record_batch([pa.array(slot), pa.array(n)], ["slot", "n"])

    got = sets.select("cluster", "shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << SIEVE_BITS, np.int64)
    table[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    sent = sets.sparkSession.sparkContext.broadcast(table)

    def prefix(batches):
        for b in batches:
            out = []
            for c, rep, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                with np.errstate(over="ignore"):
                    key = keys(c, np.frombuffer(s.as_buffer(), K.U64))
                n = sent.value[slots(key)]
                first = np.lexsort((key, n))[: len(key) - -(-percent * len(key) // 100) + 1]
                first = first[n[first] > 1]  # what no other set holds ties nothing
                out.append(np.stack((key[first].view(np.int64), np.full(len(first), rep), np.full(len(first), len(key)))))
            if out:
                part = np.concatenate(out, 1)
                yield pa.record_batch([pa.array(x) for x in part], ["key", "rep", "n"])

    rows = sets.select("cluster", "rep", "shingles").mapInArrow(prefix, "key long, rep long, n long")
    return _ties(written(_near_pairs(rows, 0, percent), "prefixes"))


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components of one cluster."""
    sizes = members.groupBy("cluster", "comp").agg(F.count("*").alias("k"))
    top = sizes.groupBy("cluster").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("all") / PARTS)))
    top = written(top.select("cluster", "all", F.col("m.comp").alias("top"), F.ceil(F.col("all") / block).cast("int").alias("mb"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("m.k")) / block)).cast("int").alias("rb")), "tops")
    full = salted_join(members.join(sets, "rep"), top.drop("all"), "cluster", hot_keys(top, "cluster", "all", members.count()))

    def blocks(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    seed = F.xxhash64("rep")
    every = full.select("cluster", F.pmod(seed, F.col("mb")).cast("int").alias("m"), F.explode(blocks("rb")).alias("r"), F.lit(False).alias("rest"), "rep", "comp", "shingles", "top")
    rest = full.where("comp != top").select("cluster", F.explode(blocks("mb")).alias("m"), F.pmod(seed, F.col("rb")).cast("int").alias("r"), F.lit(True).alias("rest"), "rep", "comp", "shingles", "top")

    def compare(table: pa.Table) -> pa.Table:
        is_rest, rep, comp = (table.column(c).to_numpy() for c in ("rest", "rep", "comp"))
        sets = [np.frombuffer(x.as_buffer(), K.U64) for x in table.column("shingles")]
        top = table.column("top")[0].as_py()
        left, right = np.flatnonzero(is_rest), np.flatnonzero(~is_rest)
        a, b = [], []
        if len(left) and len(right):
            size = np.array([len(sets[i]) for i in right])
            flat, owner = np.concatenate([sets[i] for i in right]), np.repeat(np.arange(len(right)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in left:
                lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(right))
                # two classes outside the largest component meet twice; once is enough
                ok = (100 * common >= percent * (len(sets[i]) + size - common)) & (comp[right] != comp[i]) & ((comp[right] == top) | (rep[right] < rep[i]))
                a += [int(rep[i])] * int(ok.sum())
                b += rep[right][ok].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return every.unionByName(rest).groupBy("cluster", "m", "r").applyInArrow(compare, "a long, b long")


def links_of(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, side: int, window: int) -> DataFrame:
    """Written table of links (a, b) whose components are those of all links between classes that share a bucket."""
    columns = (docs, id_col, text_col, words)
    found = written(_near_pairs(_bucket_rows(classes.where("n > 0"), side), window, percent), "found")
    pairs = written(found.where((F.col("kind") == PAIR) & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "pairs")
    links = written(confirmed(pairs, classes, *columns, percent), "links")
    group = components(links)
    stars = group.selectExpr("node AS a", "component AS b")
    members = _clusters(_ties(found), group)
    if members is not None:
        wanted = members.select("rep").join(classes.select("rep", "id", "d1"), "rep")
        sets = written(shingle_table(docs, wanted, id_col, text_col, words), "sets")
        members = _clusters(_sieve(members.join(sets, "rep").select("cluster", "rep", "shingles"), percent), group)
        if members is not None:
            stars = stars.unionByName(written(_block_links(members, sets, percent), "more"))
    dropped(found, pairs, links)
    return stars


def _component_of(classes: DataFrame, links: DataFrame, least: str) -> DataFrame:
    """(d1, d2, rep, value): for each class the least value of column ``least`` in its component."""
    group = components(links)
    named = classes.select("rep", "d1", "d2", least).join(group, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    named = written(named, "named")
    per = written(named.groupBy("comp").agg(F.min(least).alias("value"), F.count("*").alias("size")), "least")
    return salted_join(named.drop(least), per.select("comp", "value"), "comp", hot_keys(per, "comp", "size", named.count())).drop("comp")


def _of_rows(sig: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with an id beside what is known of their class. A class with very many copies is split over tasks."""
    rows = sig.where("doc_id IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "d1", "d2")
    return salted_join(rows, named.withColumnRenamed("d2", "e2"), "d1", hot_keys(classes, "d1", "k", sig.count())).where("d2 = e2")


def _id_links(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of the texts of one id."""
    rows = sig.where("doc_id IS NOT NULL").select("doc_id", "d1", "d2")
    several = rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo != hi").select("doc_id")
    several = written(several, "repeated")
    own = written(rows.join(several, "doc_id", "left_semi").distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep"), "texts")
    low = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("k"))
    return written(salted_join(own, low.select("doc_id", "a"), "doc_id", hot_keys(low, "doc_id", "k", own.count())).selectExpr("a", "rep AS b").where("a != b"), "same")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int = 3, side: int = 11, window: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by
    links of similarity >= percent), kept (doc_id = component_id)."""
    sig, classes = classes_of(docs, id_col, text_col, words, rows, side)
    links = links_of(classes, docs, id_col, text_col, words, percent, side, window)
    named = _component_of(classes, links.unionByName(_id_links(sig, classes)), "id")
    out = _of_rows(sig, classes, named).select("doc_id", "n_shingles", F.col("value").alias("component_id"), (F.col("doc_id") == F.col("value")).alias("kept"))
    none = sig.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int = 3, side: int = 11, window: int = 4) -> DataFrame:
    """The rows of one document of each group, with all their columns. A document is an id with a text here: of each group
    the one of least id (then least hash of the text) stays. Rows that repeat id and text are one document,
    of which the least row stays; rows of one id with other texts are documents of their own; rows without
    an id all stay. Every decision follows from the rows alone, not from whether ids repeat elsewhere."""
    sig, classes = classes_of(docs, id_col, text_col, words, rows, side)
    links = links_of(classes, docs, id_col, text_col, words, percent, side, window)
    of = _of_rows(sig, classes, _component_of(classes, links, "first")).groupBy("doc_id", "text_hash").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    first = (F.col("value.doc_id") == F.col("doc_id")) & (F.col("value.text_hash") == F.col("text_hash"))
    marks = written(of.select("doc_id", "text_hash", first.alias("_first"), "n").where("NOT _first OR n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_first"), "marks")

    # rows in no slot that a mark takes are passed on where they are; only the others meet the marks in a join
    bits = slot_bits(4 * marks.count())
    sent = docs.sparkSession.sparkContext.broadcast(taken_slots(marks.select(slot_of(F.xxhash64("_id", "_hash"), bits).alias("s")), bits))
    key, text_hash = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    slot = F.when(key.isNotNull(), slot_of(F.xxhash64(key, text_hash), bits))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])

    def split(marked: bool):
        def work(batches):
            for b in batches:
                at = b.column(b.num_columns - 1)
                hit = holds(sent.value, at.fill_null(0).to_numpy(zero_copy_only=False)) & at.is_valid().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == marked)).select(list(range(b.num_columns - 1)))

        return docs.select(*(docs[c] for c in docs.columns), slot.alias("_slot")).mapInArrow(work, schema)

    some = split(True)

    def same(m: DataFrame):
        return (some[id_col].cast("long") == m["_id"]) & (F.xxhash64(some[text_col].cast("string")) == m["_hash"])

    out = split(False).unionByName(some.join(marks, same(marks), "left_anti"))
    repeats = marks.where("_first")
    if repeats.head(1):
        row = F.struct(*(some[c] for c in docs.columns))
        again = some.join(repeats, same(repeats)).groupBy(repeats["_id"], repeats["_hash"]).agg(F.min(row).alias("_row"))
        out = out.unionByName(again.select("_row.*"))
    return out
