"""A whole run: arguments to flags, texts to a report and an exit code. Texts are listed, read, extracted and
linted by Spark; the driver gets the counts and the report, whose size the sinks bound."""

from __future__ import annotations

import argparse
import math
import sys
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction, linting
from ..operators.catalogue import CATEGORIES, TIER_SEVERITY
from ..sources import files, sinks
from . import config

#: Report for each format, from linted rows and their summary.
REPORTS = {
    "pretty": lambda rows, summary, verbose: sinks.pretty_report(rows, summary, verbose),
    "json": lambda rows, summary, verbose: sinks.json_report(rows, summary),
    "github": lambda rows, summary, verbose: sinks.github_report(rows, summary),
    "sarif": lambda rows, summary, verbose: sinks.sarif_report(rows),
}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise config.ConfigError(message)


def _rule(value: str) -> tuple[str, str]:
    severity, colon, name = value.partition(":")
    if not (colon and name and severity in ("off", "warn", "error", "0", "1", "2")):
        raise argparse.ArgumentTypeError(f'expects <off|warn|error>:<ruleId>, got "{value}"')
    return name, severity


def _number(value: str) -> float:
    x = float(value)
    if not math.isfinite(x):
        raise ValueError(value)
    return x


def _names(value: str) -> list[str]:
    return [x for x in (part.strip() for part in value.split(",")) if x]


def arguments(argv: list[str]) -> tuple[config.Flags, argparse.Namespace]:
    """Flags, and what is not configuration: paths, root, stdin and its name, verbose. A word that is not
    known, a number that is none or a missing value is a ConfigError."""
    p = _Parser(prog="lexilake", allow_abbrev=False)
    p.add_argument("paths", nargs="*", help="globs below the root, or one of: rules, init")
    p.add_argument("--root", default=".", help="the folder, in any store that Spark reads")
    p.add_argument("-f", "--format")
    p.add_argument("-t", "--threshold", type=_number)
    p.add_argument("--max-warnings", type=_number)
    p.add_argument("--max-hits", type=_number)
    p.add_argument("-c", "--config")
    p.add_argument("--no-config", action="store_true")
    p.add_argument("--no-mask-code", dest="mask_code", action="store_const", const=False)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--min-tier")
    p.add_argument("--only", action="append", type=_names, default=[])
    p.add_argument("--rule", action="append", type=_rule, default=[])
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--stdin", action="store_true")
    p.add_argument("--stdin-filename", default="<stdin>")
    a = p.parse_intermixed_args(argv)
    hits, warnings = (None if x is None else int(x) for x in (a.max_hits, a.max_warnings))
    flags = config.Flags(config=a.config, no_config=a.no_config, threshold=a.threshold, max_warnings=warnings, format=a.format, mask_code=a.mask_code, max_hits=hits, exclude=a.exclude, only=[x for xs in a.only for x in xs], rules=dict(a.rule), min_tier=a.min_tier, quiet=a.quiet)
    return flags, a


def wanted(paths: list[str], include: list[str]) -> list[str]:
    """Globs below the root for the paths of a run: a wildcard stands for itself, a literal one for that file and
    for the files below it that ``include`` takes, by path or, for globs without a slash, by base name."""
    out = []
    for p in paths:
        if not files.is_literal(p):
            out.append(p)
            continue
        name = PurePosixPath(p).as_posix()
        folder = "" if name == "." else f"{name}/"
        out += ([name] if folder else []) + [folder + g for g in include] + [f"{folder}**/{g}" for g in include if "/" not in g]
    return out


def linted(docs: DataFrame, settings: dict, quiet: bool = False) -> DataFrame:
    """(path, text) rows, linted as prose under resolved settings."""
    prose = docs.withColumn("text", extraction.extract_prose(F.col("text"), F.col("path")))
    out = linting.lint(prose, rules=settings["rules"], threshold=settings["threshold"], max_hits_per_rule=settings["maxHitsPerRule"], masking=settings["maskCodeSpans"])
    return linting.quiet(out) if quiet else out


def report(docs: DataFrame, settings: dict, quiet: bool = False, verbose: bool = False) -> tuple[str, int]:
    """The report in the settings' format and the exit code. A table without rows is a usage error."""
    rows = linted(docs, settings, quiet)
    summary = linting.summarize(rows, settings["maxWarnings"]).first()
    if not summary.fileCount:
        raise config.ConfigError("no files matched")
    return REPORTS[settings["format"]](rows, summary, verbose), config.EXIT_LINT if summary.failed else config.EXIT_CLEAN


def rule_table() -> str:
    """The rules with tier, default severity and number of patterns, aligned."""
    listed = [(c.id, c.tier, TIER_SEVERITY[c.tier], len(c.patterns)) for c in CATEGORIES]
    width = max(len(r[0]) for r in listed)
    lines = [f"{name:<{width}}  {tier:<8}  {severity:<7}  {n}" for name, tier, severity, n in listed]
    return "\n".join([f"{'rule id':<{width}}  tier      default  patterns", *lines, f"{len(listed)} rules, {sum(r[3] for r in listed)} patterns."])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin: str | None = None) -> tuple[str, int]:
    """Text to print and exit code: clean, findings that fail the run, or wrong usage (a message)."""
    try:
        flags, a = arguments(sys.argv[1:] if argv is None else argv)
        if a.paths[:1] == ["rules"]:
            return rule_table(), config.EXIT_CLEAN
        if a.paths[:1] == ["init"]:
            return f"wrote {config.write_starter('.').name}", config.EXIT_CLEAN
        settings, _ = config.resolve(flags, ".")
        spark = spark or SparkSession.builder.getOrCreate()
        if a.stdin:
            docs = files.one_text(spark, sys.stdin.read() if stdin is None else stdin, a.stdin_filename)
        else:
            docs = files.whole_texts(spark, a.root, wanted(a.paths, settings["include"]) if a.paths else settings["include"], settings["exclude"])
        return report(docs, settings, flags.quiet, a.verbose)
    except config.ConfigError as e:
        return f"error: {e}", config.EXIT_USAGE


if __name__ == "__main__":
    shown, code = main()
    print(shown)
    sys.exit(code)
