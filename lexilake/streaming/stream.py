"""The same row-local plans over streams: scoring and linting keep no state, so append mode and any
trigger do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import linting, scoring


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the folder of ``spark.checkpoint.dir``, removed when the application ends. Without the
    setting a local session takes a temporary folder, and a cluster's is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def documents(spark: SparkSession, folder: str, schema, pattern: str = "*", files_per_trigger: int = 64) -> DataFrame:
    """Parquet documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scores(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scoring.scored(stream.select(id_col, text_col), text_col).select(id_col, "word_count", "score", "band")


def findings(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return linting.findings_table(linting.lint(stream.select(id_col, text_col), text_col, **options), id_col)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there to Parquet, once, and stop. The checkpoint makes a rerun resume."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
