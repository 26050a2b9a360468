"""Configuration: defaults, discovery, merging, flags, validation. Plain Python on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.catalogue import BY_ID, CATEGORIES, TIERS
from ..operators.linting import expand_rules, normalize_severity

#: Names of configuration files and the key in a package file. Both are parameters of ``discover`` and
#: ``resolve``, so files that another tool left under its own names can be read.
RC_NAMES = (".lexilakerc.json", ".lexilakerc", "lexilakerc.json")
PACKAGE_KEY = "lexilake"
#: Formats and defaults of the configuration.
FORMATS = ("pretty", "json", "github", "sarif")
DEFAULTS = {
    "include": ["**/*.md", "**/*.mdx", "**/*.markdown", "**/*.txt"],
    "exclude": ["**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/vendor/**", "**/CHANGELOG.md", "**/*.min.*"],
    "rules": {}, "threshold": None, "maxWarnings": -1, "maskCodeSpans": True, "maxHitsPerRule": 0, "format": "pretty",
}
STARTER = {
    "include": DEFAULTS["include"], "exclude": DEFAULTS["exclude"], "threshold": 45, "maxWarnings": -1,
    "rules": {
        "tool_artifacts": "error", "ai_self_reference": "error", "placeholder_text": "error", "collaborative_scaffolding": "error", "knowledge_cutoff": "error",
        "emoji_formatting": "warn", "significance_statements": "warn", "negative_parallelism": "warn", "rule_of_three": "off", "ai_vocabulary": "off",
    },
}
EXIT_CLEAN, EXIT_LINT, EXIT_USAGE = 0, 1, 2


class ConfigError(ValueError):
    pass


@dataclass
class Flags:
    """What a command line can set; None or empty: not given."""

    config: str | None = None
    no_config: bool = False
    threshold: float | None = None
    max_warnings: int | None = None
    format: str | None = None
    mask_code: bool | None = None
    max_hits: int | None = None
    exclude: list = field(default_factory=list)
    only: list = field(default_factory=list)
    rules: dict = field(default_factory=dict)
    min_tier: str | None = None
    quiet: bool = False


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def validate(config: dict, source: str) -> dict:
    rules = config.get("rules") or {}
    for k in rules:
        if k not in BY_ID:
            raise ConfigError(f'Unknown rule "{k}" in {source}.')
    for k, v in rules.items():
        try:
            normalize_severity(v)
        except ValueError as e:
            raise ConfigError(f'Rule "{k}" in {source}: {e}') from e
    t = config.get("threshold")
    if t is not None and not (_number(t) and 0 <= t <= 100):
        raise ConfigError(f'"threshold" in {source} must be a number 0-100.')
    if config.get("format") is not None and config["format"] not in FORMATS:
        raise ConfigError(f'"format" in {source} must be {"|".join(FORMATS)}.')
    return config


def load(path: Path) -> dict:
    if path.suffix in (".js", ".mjs"):
        raise ConfigError(f"{path}: configuration in script form is not run; use JSON")
    try:
        found = json.loads(path.read_text("utf-8"))
    except ValueError as e:
        raise ConfigError(f"Could not parse {path}: {e}") from e
    return validate(found, str(path))


def discover(folder: str | Path = ".", names: tuple = RC_NAMES, package_key: str = PACKAGE_KEY) -> tuple[dict, str | None]:
    """The nearest folder wins; within one, its rc files before its package file. Only the first is
    read; nothing is merged. A package file that does not parse is passed over."""
    at = Path(folder).resolve()
    for here in (at, *at.parents):
        for name in names:
            if (here / name).exists():
                return load(here / name), str(here / name)
        package = here / "package.json"
        if package.exists():
            try:
                found = json.loads(package.read_text("utf-8"))
            except ValueError:
                found = None
            if isinstance(found, dict) and found.get(package_key):
                source = f"{package} ({package_key})"
                return validate(found[package_key], source), source
    return {}, None


def resolve(flags: Flags | None = None, folder: str | Path = ".", names: tuple = RC_NAMES, package_key: str = PACKAGE_KEY) -> tuple[dict, str | None]:
    """Defaults, then the file, then flags; then only, single rules, and the tier floor, which is last
    and so beats a single rule. The result's rules name every category."""
    flags = flags or Flags()
    base, source = {}, None
    if flags.config:
        path = Path(folder, flags.config)
        if not path.exists():
            raise ConfigError(f"Config file not found: {flags.config}")
        base, source = load(path), str(path)
    elif not flags.no_config:
        base, source = discover(folder, names, package_key)
    out = {**DEFAULTS, **base, "rules": dict(base.get("rules") or {})}
    for key, value in (("threshold", flags.threshold), ("maxWarnings", flags.max_warnings), ("format", flags.format), ("maskCodeSpans", flags.mask_code), ("maxHitsPerRule", flags.max_hits)):
        if value is not None:
            out[key] = value
    out["exclude"] = [*out["exclude"], *flags.exclude]
    if flags.only:
        for x in flags.only:
            if x not in BY_ID:
                raise ConfigError(f'Unknown rule "{x}" passed to --only.')
        now = expand_rules(out["rules"])
        out["rules"] = {k: (("warn" if v == "off" else v) if k in flags.only else "off") for k, v in now.items()}
    for k, v in flags.rules.items():
        if k not in BY_ID:
            raise ConfigError(f'Unknown rule "{k}" passed to --rule.')
        out["rules"][k] = v
    if flags.min_tier is not None:
        if flags.min_tier not in TIERS:
            raise ConfigError(f"--min-tier must be one of {'|'.join(TIERS)}.")
        floor = TIERS.index(flags.min_tier)
        out["rules"] |= {c.id: "off" for c in CATEGORIES if TIERS.index(c.tier) < floor}
    validate(out, source or "CLI options")
    return {**out, "rules": expand_rules(out["rules"])}, source


def write_starter(folder: str | Path = ".") -> Path:
    """Write a starter file; an existing one is never overwritten."""
    path = Path(folder) / RC_NAMES[0]
    if path.exists():
        raise ConfigError(f"{path.name} already exists")
    path.write_text(json.dumps(STARTER, indent=2) + "\n", "utf-8")
    return path
