"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Sources, in code-point order with null last, weigh 3, 1, 2, repeating, and share a budget of
``percent`` of all words; a target stops at ``most`` times its source's words and the excess is
shared out again by weight. With caps c_i and weights w_i the targets are min(c_i, L * w_i), where
L follows from one ordered pass over the sources (one row each) by rising c_i / w_i.

A source first gives as many complete epochs as its target holds. The rest is filled in order of
exponential keys, -ln(u) / quality, u from a hash of the document's id: whole documents while
their running total stays within the rest, and of the one at the boundary the words that are
left, so a source's taken words equal its target rounded down.

The running total is two-level: rows are dealt into ranges of (source, key) of about equal size,
whatever the keys' distribution, so that a source with a third of all rows, or one whose documents all have
the same small quality, spreads over many tasks; range totals are summed in order per source and the
running sum within a range starts from there. The result does not depend on where the ranges end.

``mixed`` returns the rows themselves with their texts. For each source it keeps the place in the order at which the
words run out, one row a source, and holds every document against it, so that no text is moved.

Defined results: null text: size 0, nothing taken; null source: a source of its own; null quality, or
one that is not positive: 1e-6. Rows are independent; rows that repeat an id take part each, ties
ordered by id, size and a hash of the text; rows equal in all of these share the words that are left for them
evenly in ``mixed``, which may leave fewer words than such rows untaken. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=None, carried: tuple = ()) -> DataFrame:
    """(doc_id, source, size, quality, hash, and columns carried along). Default quality: 1 where the mean length of words and their
    blanks is 3 to 12 characters, else 0.25."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"), (F.lit(None) if quality is None else quality).cast("double").alias("q"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), *carried)
    mean = F.col("chars") / F.greatest(F.col("size"), F.lit(1))
    default = F.when(mean.between(3, 12), 1.0).otherwise(0.25)
    q = default if quality is None else F.when(F.col("q") > 0, F.col("q")).otherwise(1e-6)
    return base.select("doc_id", "source", "size", q.alias("quality"), "hash", *carried)


def targets(sized: DataFrame, weights: tuple = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, n, target): one row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("source_size") * most / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(everything) * percent / 100).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("budget") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # sources are capped in this order until the level no longer reaches the next one's cap
    per = per.withColumn("level", level).withColumn("open", F.col("source_size") * most > F.col("level") * F.col("w"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("source_size") * most / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)["level"]
    target = F.when(F.isnull(final), F.col("source_size") * float(most)).otherwise(F.least(F.col("source_size") * float(most), final * F.col("w")))
    return per.select("source", "source_size", "n", target.alias("target"))


ORDER = ("key", "doc_id", "size", "hash")


def _key(seed: str):
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.col("quality")


def _dealt(sized: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """The sized rows with key, source_size, target, epochs, rest (words beyond whole epochs), ahead (of those, the ones
    that rows before this one take)."""
    keyed = sized.withColumn("key", _key(seed))
    # the number of a row's range is written with it, so that no later plan deals rows anew
    keyed = written(keyed.repartitionByRange(F.col("source").asc_nulls_last(), *ORDER).withColumn("bucket", F.spark_partition_id()), "keyed")
    inner = Window.partitionBy("source", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("ts"), F.col("bucket").alias("tb"), F.coalesce(F.sum("s").over(outer), F.lit(0)).alias("before"))
    totals = totals.join(per.withColumnRenamed("source", "ps"), F.col("ts").eqNullSafe(F.col("ps"))).drop("ps")
    rows = within.join(totals, within.source.eqNullSafe(totals.ts) & (within.bucket == totals.tb))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    return rows.select(*sized.columns, "key", "source_size", F.col("target").cast("double").alias("target"), epochs.alias("epochs"), rest.alias("rest"), (F.col("before") + F.col("inside")).alias("ahead"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=None, weights: tuple = WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row."""
    # texts are read once: all later steps work on a narrow written table
    sized = written(sizes(docs, id_col, text_col, source_col, quality), "sizes")
    rows = _dealt(sized, targets(sized, weights, percent, most), seed)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


#: So many sources' places travel to the executors by broadcast; with more the planner joins them.
MAX_SOURCES = 100_000


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=None, weights: tuple = WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """The rows with all their columns and size, source_size, target, taken. The texts are read twice and not moved."""
    sized = written(sizes(docs, id_col, text_col, source_col, quality), "sizes")
    per = targets(sized, weights, percent, most)
    rows = _dealt(sized, per, seed)
    place = F.struct(*ORDER)
    # the first place at which the words do not last, and what is left for the rows there
    over = rows.where(F.col("ahead") + F.col("size") > F.col("rest")).groupBy("source").agg(F.min(place).alias("place"))
    at = rows.join(over.select(F.col("source").alias("os"), "place"), F.col("source").eqNullSafe(F.col("os"))).where(place == F.col("place"))
    left = at.groupBy("source").agg(F.first("place").alias("place"), F.min("ahead").alias("ahead"), F.first("rest").alias("rest"), F.count("*").alias("ties"))
    left = left.select(F.col("source").alias("_ls"), "place", F.floor(F.greatest(F.lit(0), F.col("rest") - F.col("ahead")) / F.col("ties")).cast("long").alias("left"))
    ends = per.join(left, F.col("source").eqNullSafe(F.col("_ls")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    ends = written(ends.select(F.struct("source", "source_size", F.col("target").cast("double").alias("target"), epochs.alias("epochs"), "place", "left").alias("_end")), "ends")
    ends = F.broadcast(ends) if ends.count() <= MAX_SOURCES else ends
    own = sizes(docs.withColumn("_row", F.struct(*docs.columns)), id_col, text_col, source_col, quality, ("_row",)).withColumn("key", _key(seed))
    full = own.join(ends, F.col("source").eqNullSafe(F.col("_end.source")))
    here = F.when(F.col("_end.place").isNull() | (place < F.col("_end.place")), F.col("size")).when(place == F.col("_end.place"), F.least("size", "_end.left")).otherwise(0)
    taken = (F.col("_end.epochs") * F.col("size") + here).cast("long")
    more = {"size": F.col("size"), "source_size": F.col("_end.source_size"), "target": F.col("_end.target"), "taken": taken}
    return full.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in more), *(v.alias(k) for k, v in more.items()))
