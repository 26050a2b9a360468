"""The catalogue as tables, and its self-test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect, text
from .catalogue import CATEGORIES, TIER_SEVERITY
from .linting import expand_rules


def rules_table(spark: SparkSession) -> DataFrame:
    """One row for each category; ``defaultSeverity`` is the tier's."""
    rows = [(i, c.id, c.label, c.tier, TIER_SEVERITY[c.tier], c.weight, c.cap, [p.id for p in c.patterns], c.why, c.caution) for i, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "ordinal int, id string, label string, tier string, defaultSeverity string, weight int, cap int, patterns array<string>, why string, caution string")


def patterns_table(spark: SparkSession) -> DataFrame:
    """One row for each pattern, with its key category.pattern and its Java expression."""
    rows = [(i, j, f"{c.id}.{p.id}", c.id, p.id, p.flags, dialect.java(p.regex, p.flags), p.vendor, p.era, list(p.examples)) for i, c in enumerate(CATEGORIES) for j, p in enumerate(c.patterns)]
    return spark.createDataFrame(rows, "category_ordinal int, ordinal int, key string, category string, pattern string, flags string, regex string, vendor string, era string, examples array<string>")


def resolved(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """Severity of each category under the given rules."""
    of = expand_rules(rules)
    return spark.createDataFrame([(c.id, c.tier, of[c.id]) for c in CATEGORIES], "category string, tier string, severity string")


def health(spark: SparkSession) -> DataFrame:
    return rules_table(spark).agg(F.lit("ok").alias("status"), F.count("*").alias("categories"), F.sum(F.size("patterns")).alias("patterns"))


def self_test(spark: SparkSession) -> DataFrame:
    """One row for each example: whether its own pattern matches it. One literal expression for each
    pattern, chosen by key, so that no expression is compiled per row."""
    rows = patterns_table(spark).select("category", "pattern", "key", F.posexplode("examples").alias("n", "example"))
    found = F.lit(None).cast("boolean")
    for c in CATEGORIES:
        for p in c.patterns:
            found = F.when(F.col("key") == f"{c.id}.{p.id}", text.normalize(F.col("example"), False).rlike(dialect.java(p.regex, p.flags)) | F.col("example").rlike(dialect.java(p.regex, p.flags))).otherwise(found)
    return rows.select("category", "pattern", "n", "example", found.alias("matched"))
