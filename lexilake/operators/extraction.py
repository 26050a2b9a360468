"""Reduce a file's text to the prose worth a look, length kept: everything else is blanked in place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import SPACE
from ..functions.text import blank_spans, extension, has, keep_spans

#: Extensions by kind of file.
PROSE = (".md", ".mdx", ".markdown", ".mdown", ".txt", ".rst", ".adoc", ".org")
MARKDOWN = (".md", ".mdx", ".markdown", ".mdown")
HTML = (".html", ".htm", ".vue", ".svelte")
CODE = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".py", ".rb", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".cs", ".php", ".sh", ".yml", ".yaml")

_S, _N = f"[{SPACE}]", f"[^{SPACE}"
_BOL, _EOL = r"(?<![^\n\r\x{2028}\x{2029}])", r"(?![^\n\r\x{2028}\x{2029}])"
_ANY = r"[^\n\r\x{2028}\x{2029}]"

FRONT_MATTER = (r"\A---\r?\n[\s\S]*?\r?\n---(?=\r?\n|\z)", r"\A\+\+\+\r?\n[\s\S]*?\r?\n\+\+\+(?=\r?\n|\z)")
URLS = (
    rf'\]\({_N})]+(?:{_S}+"[^"]*")?\)',
    rf"{_BOL}{_S}*\[[^\]]+\]:{_S}*{_N}]+{_ANY}*{_EOL}",
    r"<https?://[^>]+>",
    rf"https?://{_N}]+",
)
TAGS = (r"<!--[\s\S]*?-->", r"(?i)<script(?![A-Za-z0-9_])[\s\S]*?</script>", r"(?i)<style(?![A-Za-z0-9_])[\s\S]*?</style>", r"</?[a-zA-Z][^>]*>")
TABLES = rf"{_BOL}\|{_ANY}*\|[ \t]*{_EOL}"
COMMENTS = rf"/\*[\s\S]*?\*/|(?:{_BOL}|[^:])//[^\n]*|{_BOL}{_S}*#[^\n]*"


def mask_front_matter(x: Column) -> Column:
    x = blank_spans(x, FRONT_MATTER[0], lambda t: t.startswith("---"))
    return blank_spans(x, FRONT_MATTER[1], lambda t: t.startswith("+++"))


def mask_urls(x: Column) -> Column:
    for regex, mark in zip(URLS, ("](", "]:", "<http", "http")):
        x = blank_spans(x, regex, lambda t, mark=mark: has(t, mark))
    return x


def mask_html(x: Column) -> Column:
    for regex in TAGS:
        x = blank_spans(x, regex, lambda t: has(t, "<"))
    return x


def mask_tables(x: Column) -> Column:
    return blank_spans(x, TABLES, lambda t: has(t, "|"))


def extract_comments(x: Column) -> Column:
    return keep_spans(x, COMMENTS)


def extract_prose(x: Column, path: Column, comments_only: bool = False) -> Column:
    """struct(text, mode) by the path's extension."""
    if comments_only:
        return F.struct(extract_comments(x).alias("text"), F.lit("comments").alias("mode"))
    ext = extension(F.coalesce(path, F.lit("")))

    def result(text, mode):
        return F.struct(text.alias("text"), F.lit(mode).alias("mode"))

    return (
        F.when(ext.isin(*CODE), result(extract_comments(x), "comments"))
        .when(ext.isin(*HTML), result(mask_urls(mask_html(x)), "html"))
        .when(ext.isin(*MARKDOWN), result(mask_tables(mask_urls(mask_html(mask_front_matter(x)))), "markdown"))
        .otherwise(result(mask_urls(mask_front_matter(x)), "text"))
    )


def is_lintable(path: Column) -> Column:
    return extension(path).isin(*PROSE, *HTML, *CODE)
