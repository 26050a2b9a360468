"""A PySpark-native engine for text-style analytics over collections of documents."""

from __future__ import annotations

import os
from pathlib import Path


def ship(spark) -> None:
    """Let Python workers find this package where the session was not started with it on its path. On a
    cluster the package is installed on the workers or sent with --py-files."""
    root, key = str(Path(__file__).resolve().parent.parent), "PYTHONPATH"
    known = spark.sparkContext.environment.get(key) or os.environ.get(key, "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment[key] = os.pathsep.join(x for x in (root, known) if x)
