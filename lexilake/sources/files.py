"""File sources: glob patterns, whole texts, corpora, tables."""

from __future__ import annotations

import os
import re
from functools import reduce
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import DEFAULTS

_SPECIAL = ".+^$()|\\"


def is_literal(glob: str) -> bool:
    return not any(c in glob for c in "*?{[")


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ``*`` and ``?`` stay within a segment, ``**/`` is any
    number of segments, ``{a,b}`` alternatives (in which ``*`` may stand), ``[abc]`` a class. An opening
    sign without its end stands for itself."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        rest = glob[at:]
        if rest.startswith("**/"):
            out, at = out + "(?:[^/]*(?:/|$))*", at + 3
        elif rest.startswith("**"):
            out, at = out + ".*", at + 2
        elif c == "*":
            out, at = out + "[^/]*", at + 1
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c in "{[" and (end := glob.find("}" if c == "{" else "]", at)) >= 0:
            if c == "[":
                out += glob[at : end + 1]
            else:
                names = [re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", x).replace("*", "[^/]*") for x in glob[at + 1 : end].split(",")]
                out += f"(?:{'|'.join(names)})"
            at = end + 1
        else:
            out, at = out + ("\\" + c if c in _SPECIAL + "{[" else c), at + 1
    return f"^{out}$"


def matches(path: Column, globs: list[str]) -> Column:
    """Any glob matches the path (with / as separator)."""
    return reduce(lambda a, g: a | path.rlike(glob_regex(g)), globs, F.lit(False))


def _any(path: str, globs: list[str]) -> bool:
    return any(re.search(glob_regex(g), path) for g in globs)


def expand(patterns: list[str], root: str | Path = ".", include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Files on the driver's disk: a literal file as it is, a literal folder walked with ``include`` (which
    may match the base name alone), a wildcard against a walk of the root. Excluded folders are not
    entered; walks yield nothing outside the root. Sorted, each once."""
    root = Path(root).resolve()
    include, exclude = include or [], exclude or []
    found: set[str] = set()

    def relative(p: Path) -> str:
        return PurePosixPath(os.path.relpath(p, root)).as_posix()

    def walk(folder: Path, wanted) -> None:
        for here, folders, names in os.walk(folder):
            rel = relative(Path(here))
            if rel.startswith(".."):
                folders.clear()
                continue
            prefix = "" if rel == "." else rel + "/"
            folders[:] = [f for f in folders if not _any(prefix + f, exclude) and not _any(prefix + f + "/", exclude)]
            found.update(str(Path(here, n)) for n in names if Path(here, n).is_file() and not _any(prefix + n, exclude) and wanted(prefix + n))

    wild = [p for p in patterns if not is_literal(p)]
    for p in (p for p in patterns if is_literal(p)):
        full = (root / p).resolve()
        if full.is_file():
            if not _any(relative(full), exclude):
                found.add(str(full))
        elif full.is_dir():
            walk(full, lambda rel: _any(rel, include or ["**/*"]) or _any(PurePosixPath(rel).name, include or ["**/*"]))
    if wild:
        walk(root, lambda rel: _any(rel, wild))
    return sorted(found)


def whole_texts(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, text) of each file below a folder that Spark can read, path relative to it. Files are
    listed and read by Spark, never on the driver; an unreadable one is skipped."""
    base = path.rstrip("/")
    files = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").format("text").option("wholetext", "true").load(base)
    place = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:/+", "/")
    root = re.sub(r"^[a-z0-9]+:/+", "/", base)
    rows = files.select(F.when(place.startswith(root + "/"), F.substring(place, F.lit(len(root) + 2), F.length(place))).otherwise(place).alias("path"), F.col("value").alias("text"))
    include = include or DEFAULTS["include"]
    rows = rows.where(matches(F.col("path"), include))
    exclude = DEFAULTS["exclude"] if exclude is None else exclude
    return rows.where(~matches(F.col("path"), exclude)) if exclude else rows


def one_text(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(name, text)], "path string, text string")


def corpus_json(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """A labelled corpus: arrays of {id, text} and, for some, date."""
    rows = spark.read.schema("id string, text string, date string").option("multiLine", "true").json(path)
    return rows.select(F.lit(corpus).alias("corpus"), F.col("id").alias("doc_id"), "text", "date")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Files fewer than the cores, and so small, are dealt out before work that is heavy on the CPU.
SPREAD_FILES = 4


def spread(df: DataFrame) -> DataFrame:
    """A table of very few files may come as one task however many cores there are; only then its rows are
    dealt out. Tables of many files, that is large ones, are left as they are: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) <= SPREAD_FILES < cores else df
