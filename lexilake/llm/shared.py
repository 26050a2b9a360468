"""Where operators keep written tables, joins that split hot keys, slot filters, and connected components
over link tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 60
#: A key is hot above so small a share of all rows: fewer than HOT_KEYS keys can be.
HOT_KEYS = 4096
#: Tasks over which a hot key's rows are dealt.
SALTS = 64
#: A table of so many links at most (16 bytes each) is handled by one task, without a shuffle and as one file.
ONE_TASK = 1 << 17
#: Bytes of a batch of rows on its way to a Python worker. Spark's own bound is 64 MB, more than a task's texts have; a batch
#: is held several times over, outside the heap and in the worker, and neither gives all of that back.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: A slot filter has SLOTS_PER_KEY slots for each key, 2^LEAST_BITS at least and 2^MOST_BITS (128 MB) at most.
SLOTS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 16, 30


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset (tests on one machine) a
    temporary folder is set; a cluster session without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lexilake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark)}/lexilake-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches in this session have some BATCH_BYTES, or one longer row; where the session has a bound of its
    own, that stays. Narrow rows go as many at once as before."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(counts: DataFrame, key: str, count: str, total: int) -> list:
    """The keys with more than 1/HOT_KEYS of ``total`` rows. The counts add up to ``total`` at most, so that the
    driver gets fewer than HOT_KEYS keys, whatever the table."""
    return [r[0] for r in counts.where(F.col(count) > max(64.0, total / HOT_KEYS)).select(key).distinct().collect()]


def salted_join(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``. The rows of hot keys are dealt over SALTS tasks and the
    table's rows of those keys copied to each, so that no task gets all rows of one key."""
    if not hot:
        return rows.join(table, key)
    others = [c for c in rows.columns if c != key]
    left = rows.withColumn("_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def slot_bits(keys: int) -> int:
    """Bits of a slot number of a filter for so many keys."""
    return min(MOST_BITS, max(LEAST_BITS, (SLOTS_PER_KEY * keys - 1).bit_length()))


def slot_of(value: Column, bits: int) -> Column:
    return F.pmod(value, F.lit(1 << bits))


def taken_slots(slots: DataFrame, bits: int) -> np.ndarray:
    """A bit for each slot number (``slots``: one long column) below 2^bits, eight to a byte. The bits are
    put together in the executors; the driver gets 2^bits / 8 bytes, whatever the number of rows."""
    name = slots.columns[0]
    at = F.col(name) + 1
    parts = slots.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for b, m in parts.collect():
        part = np.frombuffer(m, np.uint8)
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(part)] = part
    return out


def holds(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether each slot's bit is set."""
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: long). Returns (node, component), the component
    being its smallest node; only nodes that have a link appear.

    Alternating large-star and small-star steps, each a partial aggregation and a join in which a
    hub's neighbours are split over tasks. Each step is written to the shared folder. Links never reach
    the driver, only one row of counts per round. Once ONE_TASK links or fewer are left, a step is one task
    that writes one file: the same steps, without the cost of many tasks and files for next to no rows."""

    def together(e: DataFrame, n: int):
        return e.coalesce(1) if n <= ONE_TASK else e

    def joined(e: DataFrame, low: DataFrame, n: int):
        return e.join(low.select("u", "m"), "u") if n <= ONE_TASK else salted_join(e, low.select("u", "m"), "u", hot_keys(low, "u", "k", n))

    some = links.where("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v")
    edges = written(together(some, links.count()).distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    for k in range(MAX_ROUNDS):
        n = now[0]
        if not n:
            break
        # large star: every larger neighbour of u is tied to the least neighbour of u
        near = together(edges, n)
        both = near.select(F.inline(F.expr("array(named_struct('u', u, 'w', v), named_struct('u', v, 'w', u))")))
        low = both.groupBy("u").agg(F.min("w").alias("m"), F.count_if(F.col("w") > F.col("u")).alias("k")).where("k > 0").selectExpr("u", "least(u, m) AS m", "k")
        star = written(joined(near.selectExpr("v AS u", "u AS w"), low, n).selectExpr("w AS u", "m AS v").where("u != v").distinct(), f"large{k}")
        # small star: every smaller neighbour of u, and u, are tied to the least of them; a star has no more links than there were
        near = together(star, n)
        low = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        pair = F.inline(F.expr("array(named_struct('a', v, 'b', m), named_struct('a', u, 'b', m))"))
        old, edges = edges, written(joined(near, low, n).select(pair).selectExpr("a AS u", "b AS v").where("u != v").distinct(), f"small{k}")
        dropped(old, star)
        was, now = now, state(edges)
        if now == was:
            break
    else:
        raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.selectExpr("u AS node", "v AS component").unionByName(roots)
