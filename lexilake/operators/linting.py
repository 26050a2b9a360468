"""Positioned, severity-resolved findings, computed inside each document's row: no shuffle, so the
same plan serves batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..functions.dialect import SPACE
from . import matching, scoring
from .catalogue import CATEGORIES, RULE_SEVERITY, TIER_SEVERITY

FINDING = "struct<line: int, column: int, c: int, p: int, k: int, endColumn: int, offset: int, match: string, size: int>"


def normalize_severity(value) -> str:
    """off, warn or error from 0, 1, 2, their strings, booleans and names."""
    if isinstance(value, bool):
        return "error" if value else "off"
    names = {0: "off", 1: "warn", 2: "error", "0": "off", "1": "warn", "2": "error", "off": "off", "warn": "warn", "warning": "warn", "error": "error"}
    if isinstance(value, (int, str)) and value in names:
        return names[value]
    raise ValueError(f"Invalid severity: {value!r} (use off|warn|error or 0|1|2)")


def resolve_severity(category_id: str, tier: str, rules: dict | None = None) -> str:
    """Explicit rule, then the rule's own default, then the tier's."""
    explicit = (rules or {}).get(category_id)
    if explicit is not None:
        return normalize_severity(explicit)
    return RULE_SEVERITY.get(category_id, TIER_SEVERITY.get(tier, "off"))


def expand_rules(rules: dict | None = None) -> dict[str, str]:
    return {c.id: resolve_severity(c.id, c.tier, rules) for c in CATEGORIES}


def _placed(hits: Column) -> Column:
    """Hits of one category (in order) as findings in UTF-16 units; a sentence end and white space
    before the phrase are left out, unless they are all of the match."""

    def one(h: Column, k: Column) -> Column:
        lead = F.length(F.regexp_extract(h["m"], rf"^[.!?]?[{SPACE}]*", 0))
        lead = F.when(lead < F.length(h["m"]), lead).otherwise(0)

        def at(n: Column) -> Column:
            start = h["off"] + n
            phrase = text.trim(F.substring(h["m"], n + 1, F.length(h["m"])))

            def whole(p: Column) -> Column:
                column = text.column_of(F.col("raw"), start)
                end = column + text.utf16_length(F.element_at(F.split(p, "\n", -1), 1))
                return F.struct(text.line_of(F.col("raw"), start).cast("int").alias("line"), column.alias("column"), h["c"].alias("c"), h["p"].alias("p"), k.cast("int").alias("k"), end.alias("endColumn"), text.utf16_offset(F.col("raw"), start).alias("offset"), p.alias("match"), text.utf16_length(p).alias("size"))

            return text.let(phrase, whole)

        return text.let(lead, at)

    return F.transform(hits, one)


def _by(*keys) -> callable:
    """Comparator over struct fields; ``-name`` sorts from large to small."""

    def compare(a: Column, b: Column) -> Column:
        out = None
        for k in keys:
            x, y = (b[k[1:]], a[k[1:]]) if k[0] == "-" else (a[k], b[k])
            step = F.when(x < y, -1).when(x > y, 1)
            out = step if out is None else F.coalesce(out, step)
        return F.coalesce(out, F.lit(0))

    return compare


def dedupe(findings: Column) -> Column:
    """Of overlapping findings of one category the longest stays; half-open spans; ties by position,
    then catalogue order."""
    ordered = F.array_sort(findings, _by("-size", "line", "column", "p", "k"))
    return F.aggregate(ordered, F.array().cast(f"array<{FINDING}>"), lambda kept, f: F.when(F.exists(kept, lambda k: (f["offset"] < k["offset"] + k["size"]) & (f["offset"] + f["size"] > k["offset"])), kept).otherwise(F.array_append(kept, f)))


def severities(rules: dict | Column | None) -> list[str | Column]:
    """Severity of each category: a name, or a column where the rules differ from row to row (a
    map<string,string> column of valid severities)."""
    if not isinstance(rules, Column):
        return list(expand_rules(rules).values())

    def one(c) -> Column:
        v = F.try_element_at(rules, F.lit(c.id))
        named = F.when(v.isin("0", "false", "off"), "off").when(v.isin("1", "warn", "warning"), "warn").when(v.isin("2", "true", "error"), "error")
        return F.coalesce(named, F.lit(resolve_severity(c.id, c.tier)))

    return [one(c) for c in CATEGORIES]


def lint(docs: DataFrame, text_col: str = "text", rules: dict | Column | None = None, threshold: float | Column | None = None, max_hits_per_rule: int | Column = 0, masking: bool = True, overlaps: bool = False, composing: bool = True) -> DataFrame:
    """Adds word_count, metrics, score, band, findings, errorCount, warningCount, thresholdExceeded.

    Findings are sorted by line, column, rule id. The score counts every category, whatever its
    severity, over uncut surfaces, and takes a text without words as one word long. The hit cap is
    applied per category, in catalogue order, before overlaps are removed; ``overlaps`` keeps them.
    Rules, threshold and cap may be columns, for batches of requests."""
    severity = severities(rules)
    out = matching.with_hits(docs, text_col, None, masking, composing)
    out = out.withColumn("word_count", text.word_count(F.col("norm"))).withColumn("metrics", metrics.metrics(F.col("raw"), F.col("norm")))
    total = scoring.total_points(F.col("hits"), False) + metrics.bonus(F.col("metrics"))
    out = out.withColumn("score", scoring.final_score(total, scoring.length_factor(F.greatest("word_count", F.lit(1))))).withColumn("band", scoring.band(F.col("score")))
    none = F.array().cast(f"array<{FINDING}>")

    def of_category(i: Column) -> Column:
        own = scoring.hits_of(F.col("hits"), i)
        if isinstance(max_hits_per_rule, Column):
            own = F.when(max_hits_per_rule > 0, F.slice(own, F.lit(1), max_hits_per_rule)).otherwise(own)
        elif max_hits_per_rule:
            own = F.slice(own, 1, max_hits_per_rule)
        placed = _placed(own)
        return placed if overlaps else dedupe(placed)

    # one expression runs over the categories that are on and have hits
    on = [F.when(s != "off", i) if isinstance(s, Column) else F.lit(i) for i, s in enumerate(severity) if isinstance(s, Column) or s != "off"]
    ids = F.array(*(text.constants(f"{c.id}/{p.id}" for p in c.patterns) for c in CATEGORIES))

    def full(f: Column) -> Column:
        def pick(values):
            return F.element_at(F.array(*values) if isinstance(values[0], Column) else text.constants(values), f["c"] + 1)

        label = pick([c.label for c in CATEGORIES])
        cut = F.when(f["size"] > 60, F.concat(text.first_units(f["match"], 59), F.lit("…"))).otherwise(f["match"])
        rule = F.element_at(F.element_at(ids, f["c"] + 1), f["p"] + 1)
        return F.struct(
            f["line"].alias("line"), f["column"].alias("column"), rule.alias("ruleId"), pick([c.id for c in CATEGORIES]).alias("category"), label.alias("categoryLabel"),
            F.element_at(F.split(rule, "/"), -1).alias("pattern"), pick(severity).alias("severity"), pick([c.tier for c in CATEGORIES]).alias("tier"),
            f["endColumn"].alias("endColumn"), f["offset"].alias("offset"), f["match"].alias("match"), text.line_text(F.col("raw"), f["line"]).alias("text"),
            F.concat(label, F.lit(": "), F.substring(F.to_json(F.struct(cut.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(cut.alias("x")))) - 6)).alias("message"),
            pick([c.why for c in CATEGORIES]).alias("help"), pick([c.caution for c in CATEGORIES]).alias("caution"), f["k"].alias("k"),
        )

    every = F.flatten(F.transform(F.array_intersect(F.array(*on), F.col("hits.c")), of_category)) if on else none
    out = out.withColumn("findings", F.array_sort(F.transform(every, full), _by("line", "column", "ruleId", "k")))
    out = out.withColumn("findings", F.transform("findings", lambda f: f.dropFields("k")))

    def count(s):
        return F.size(F.filter("findings", lambda f: f["severity"] == s))

    over = F.lit(False) if threshold is None else F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.withColumn("errorCount", count("error")).withColumn("warningCount", count("warn")).withColumn("thresholdExceeded", over).drop("hits", "working", "norm")


def quiet(linted: DataFrame) -> DataFrame:
    """Drop warnings and zero their count, which also disarms a bound on warnings."""
    return linted.withColumn("findings", F.filter("findings", lambda f: f["severity"] == "error")).withColumn("warningCount", F.lit(0))


def findings_table(linted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each finding. ``inline`` and not ``explode``: for the latter the optimizer computes the
    array anew for each field that is asked for."""
    numbered = F.transform("findings", lambda f, i: f.withField("ordinal", i.cast("int")))
    return linted.select(id_col, F.inline(numbered))


def summarize(linted: DataFrame, max_warnings: int = -1) -> DataFrame:
    """One row of counts: fileCount, errorCount, warningCount, overThreshold (documents), maxWarnings, failed."""
    agg = linted.agg(F.count("*").alias("fileCount"), F.coalesce(F.sum("errorCount"), F.lit(0)).alias("errorCount"), F.coalesce(F.sum("warningCount"), F.lit(0)).alias("warningCount"), F.count_if("thresholdExceeded").alias("overThreshold"))
    failed = (F.col("errorCount") > 0) | (F.col("overThreshold") > 0)
    if max_warnings >= 0:
        failed = failed | (F.col("warningCount") > max_warnings)
    return agg.withColumn("maxWarnings", F.lit(max_warnings)).withColumn("failed", failed)


def over_threshold(linted: DataFrame, path: Column) -> DataFrame:
    """(filePath, score) of the documents over the threshold: a table, as their number has no bound."""
    return linted.where("thresholdExceeded").select(path.alias("filePath"), "score")
