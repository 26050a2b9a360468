"""Report formats over linted documents: columns ``path``, those of ``linting.lint``.

Each format has a row form, which Spark writes in parallel (``write_lines``), and a whole-document form
for the driver, which refuses more than ``MAX_DOCUMENTS`` documents or ``MAX_LINES`` findings. Each evaluates its rows once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import first_units, utf16_length
from ..operators.catalogue import CATEGORIES, TIER_SEVERITY

MAX_DOCUMENTS, MAX_LINES = 10_000, 200_000
DISCLAIMER = "Style signals only. Not evidence of authorship. Published AI detectors show false-positive rates up to 61% on human text by non-native English writers."
TOOL, VERSION = "lexilake", "0.1.0"
LEVEL = {"error": "error", "warn": "warning", "off": "none"}
TIER_MARK = {"critical": "!!", "high": "! ", "medium": "~ ", "low": "· "}
FINDING_FIELDS = ("ruleId", "category", "severity", "tier", "line", "column", "endColumn", "match", "message")


def result_struct() -> Column:
    findings = F.transform("findings", lambda f: F.struct(*(f[k].alias(k) for k in FINDING_FIELDS)))
    return F.struct(F.col("path").alias("filePath"), "score", "band", F.col("word_count").alias("wordCount"), "errorCount", "warningCount", "thresholdExceeded", "metrics", findings.alias("findings"))


_KEEP_NULLS = {"ignoreNullFields": "false"}


def json_lines(linted: DataFrame) -> DataFrame:
    """One result object for each document."""
    return linted.select("path", F.to_json(result_struct(), _KEEP_NULLS).alias("value"))


def _bounded(rows: DataFrame, most: int = MAX_DOCUMENTS, what: str = "documents") -> list[Row]:
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} {what}: write the row form instead")
    return got


def json_report(linted: DataFrame, summary: Row) -> str:
    results = [json.loads(r.value) for r in _bounded(json_lines(linted).orderBy("path"))]
    head = {"files": summary.fileCount, "errors": summary.errorCount, "warnings": summary.warningCount, "overThreshold": [{"filePath": r["filePath"], "score": r["score"]} for r in results if r["thresholdExceeded"]], "failed": summary.failed}
    return json.dumps({"version": 1, "summary": head, "disclaimer": DISCLAIMER, "results": results}, indent=2, ensure_ascii=False)


def _escaped(x: Column, prop: bool = False) -> Column:
    pairs = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")) + (((":", "%3A"), (",", "%2C")) if prop else ())
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def github_lines(linted: DataFrame) -> DataFrame:
    """(path, n, value): workflow commands, one for each finding and one for a document over the
    threshold."""
    def command(f: Column) -> Column:
        kind = F.when(f["severity"] == "error", "error").otherwise("warning")
        message = _escaped(F.concat(f["message"], F.lit(" ["), f["ruleId"], F.lit("] — "), f["help"]))
        return F.concat(F.lit("::"), kind, F.lit(" file="), _escaped(F.col("path"), True), F.lit(",line="), f["line"], F.lit(",col="), f["column"], F.lit(",endColumn="), f["endColumn"], F.lit(",title="), _escaped(f["categoryLabel"], True), F.lit("::"), message)

    over = F.concat(F.lit("::error file="), _escaped(F.col("path"), True), F.lit(",line=1,title=Score threshold::Document score "), F.col("score"), F.lit(" ("), F.col("band"), F.lit(") is at or above the configured threshold."))
    lines = F.concat(F.transform("findings", command), F.when(F.col("thresholdExceeded"), F.array(over)).otherwise(F.array().cast("array<string>")))
    return linted.select("path", F.inline(F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("n"), x.alias("value")))))


def github_report(linted: DataFrame, summary: Row) -> str:
    lines = [r.value for r in _bounded(github_lines(linted).orderBy("path", "n"), MAX_LINES, "findings")]
    return "\n".join([*lines, f"::notice title={TOOL}::{summary.errorCount} errors, {summary.warningCount} warnings across {summary.fileCount} files. Style signals only — not evidence of authorship."])


def sarif_results(linted: DataFrame) -> DataFrame:
    """(path, n, value): one SARIF result object for each finding; its rule is the category."""
    fields = ("line", "column", "endColumn", "match", "message", "help", "category", "severity", "tier", "pattern")
    numbered = F.transform("findings", lambda x, i: F.struct(i.cast("int").alias("n"), *(x[k].alias(k) for k in fields)))
    rows = linted.select("path", "score", F.inline(numbered))
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("endColumn").alias("endColumn"), F.struct(F.col("match").alias("text")).alias("snippet"))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.struct(F.concat(F.col("message"), F.lit(" — "), F.col("help")).alias("text"))
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    result = F.struct(F.col("category").alias("ruleId"), level.alias("level"), message.alias("message"), F.array(location).alias("locations"), F.struct(F.col("tier").alias("tier"), F.col("pattern").alias("pattern"), F.col("score").alias("documentScore")).alias("properties"))
    return rows.select("path", "n", F.to_json(result, _KEEP_NULLS).alias("value"))


def sarif_report(linted: DataFrame) -> str:
    rules = [{"id": c.id, "name": c.label, "shortDescription": {"text": c.label}, "fullDescription": {"text": f"{c.why} False positives: {c.caution}"}, "defaultConfiguration": {"level": LEVEL[TIER_SEVERITY[c.tier]]}, "properties": {"tier": c.tier, "tags": ["style", "ai-generated-text"]}} for c in CATEGORIES]
    results = [json.loads(r.value) for r in _bounded(sarif_results(linted).orderBy("path", "n"), MAX_LINES, "findings")]
    run = {"tool": {"driver": {"name": TOOL, "version": VERSION, "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def pretty_blocks(linted: DataFrame, verbose: bool = False) -> DataFrame:
    """(path, value): an aligned block for each document with something to show."""
    def pad(x: Column, width: Column) -> Column:
        return F.rpad(x, width, F.lit(" "))

    place = F.transform("findings", lambda f: F.concat(f["line"], F.lit(":"), f["column"]))
    width = F.array_max(F.transform(place, lambda p: F.length(p)))
    rule = F.array_max(F.transform("findings", lambda f: F.length(f["ruleId"])))
    mark = F.create_map(*(F.lit(x) for kv in TIER_MARK.items() for x in kv))

    def line(f: Column) -> Column:
        match = F.when(utf16_length(f["match"]) > 48, F.concat(first_units(f["match"], 47), F.lit("…"))).otherwise(f["match"])
        quoted = F.to_json(F.struct(match.alias("x")))
        quoted = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
        kind = F.when(f["severity"] == "error", "error  ").otherwise("warning")
        return F.concat(F.lit("  "), pad(F.concat(f["line"], F.lit(":"), f["column"]), F.col("w")), F.lit("  "), kind, F.lit("  "), F.element_at(mark, f["tier"]), F.lit(" "), f["categoryLabel"], F.lit("  "), quoted, F.lit("  "), pad(f["ruleId"], F.col("r")))

    head = F.concat(F.col("path"), F.lit("  score "), F.col("score"), F.lit("/100 · "), F.col("band"), F.lit(" · "), F.col("word_count"), F.lit(" words"))
    over = F.when(F.col("thresholdExceeded"), F.concat(F.lit("  error  document score "), F.col("score"), F.lit(" is at or above the configured threshold")))
    m = F.col("metrics")
    more = F.concat(F.lit("  metrics: em dashes "), m["emDash"]["perThousand"], F.lit("/1k ("), m["emDash"]["spaced"], F.lit(" spaced) · sentence CV "), F.coalesce(m["burstiness"]["cv"].cast("string"), F.lit("n/a")), F.lit(" · quotes mixed "), F.when(m["quotes"]["mixed"], "yes").otherwise("no"))
    shown = linted.where((F.size("findings") > 0) | F.col("thresholdExceeded")).withColumn("w", F.coalesce(width, F.lit(0))).withColumn("r", F.coalesce(rule, F.lit(0)))
    return shown.select("path", F.concat_ws("\n", head, F.transform("findings", line), over, *([more] if verbose else [])).alias("value"))


def pretty_report(linted: DataFrame, summary: Row, verbose: bool = False) -> str:
    blocks = ["\n" + r.value for r in _bounded(pretty_blocks(linted, verbose).orderBy("path"))]

    def count(n: int, what: str) -> str:
        return f"{n} {what}{'' if n == 1 else 's'}"

    if not (summary.errorCount or summary.warningCount or summary.overThreshold):
        end = f"✓ {count(summary.fileCount, 'file')} checked, nothing flagged"
    else:
        bits = [count(n, what) for n, what in ((summary.errorCount, "error"), (summary.warningCount, "warning"), (summary.overThreshold, "document")) if n]
        end = ", ".join(bits) + f" in {count(summary.fileCount, 'file')}"
    return "\n".join([*blocks, "", end, DISCLAIMER])


def write_lines(lines: DataFrame, path: str) -> None:
    """Any row form, as text files."""
    lines.select("value").write.text(path)
