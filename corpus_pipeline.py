"""The corpus pipeline: five stages over documents, each written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm import decontaminate, minhash, mixing, nbsvm, secret_scan
from lexilake.llm.shared import bounded_batches, new_folder, written

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the threshold. Rows with null text are scored as empty."""
    bounded_batches(spark)
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nbsvm.keep(docs, model, QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of least id, of each group. A document is an id with a text: rows that
    repeat both are one document, rows of one id with other texts are documents of their own. Rows
    without an id all stay."""
    bounded_batches(spark)
    return minhash.keep_one(docs, words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    bounded_batches(spark)
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = written(found.select(F.col("doc_id").alias("leaked_id")).distinct(), "leaked")  # its size is known to the planner then
    return docs.join(leaked, docs.doc_id == leaked.leaked_id, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark and brings n_chars up to date."""
    bounded_batches(spark)
    return secret_scan.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: every document left, its text as redacted, and how many of its words the mix takes."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

#: Trained models, hashing and grammars have no SQL form: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
