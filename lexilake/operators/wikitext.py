"""Wikitext to prose, as chained replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, replacement) in order, by kind of source page.
_TEMPLATE = (r"\{\{[^{}]*\}\}", " ")
_LINKS = ((r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"\[https?://\S+ ([^\]]*)\]", "$1"))
_REFS = ((r"<ref[^>]*/>", " "), (r"(?s)<ref[^>]*>.*?</ref>", " "), (r"(?s)<!--.*?-->", " "))
_BLANKS = (r"\n{3,}", "\n\n")
HUMAN = (_TEMPLATE, _TEMPLATE, *_REFS, (r"<[^>]+>", " "), *_LINKS, (r"\[https?://\S+\]", " "), (r"(?m)^\s*[\|!\{].*$", ""), (r"'''?", ""), (r"(?si)==+\s*(?:References|External links|See also|Further reading|Notes|Bibliography)\s*==+.*", ""), _BLANKS)
ASSISTED = (_TEMPLATE, _TEMPLATE, _TEMPLATE, *_REFS, (r"</?(?:div|span|small|nowiki|syntaxhighlight|pre|blockquote)[^>]*>", " "), *_LINKS, (r"'''?", ""), (r"(?si)==+\s*(?:References|External links|See also|Further reading|Notes)\s*==+.*", ""), _BLANKS)
#: Headings of the chat variant come first: level n becomes n signs.
CHAT = (
    *((rf"\{{\{{fake heading\|level={n}\|([^}}]*)\}}\}}", "\n" + "#" * n + " $1\n") for n in range(1, 10)),
    (r"\{\{fake heading\|([^}]*)\}\}", "\n## $1\n"), (r"\{\{highlight\|([^|}]*)(?:\|[^}]*)?\}\}", "$1"), (r"\{\{xt\|([^}]*)\}\}", "$1"), (r"\{\{=\}\}", "="),
    _TEMPLATE, _TEMPLATE, _TEMPLATE, (r"(?m)^\|.*$", ""), (r"<br\s*/?>", "\n"), (r"</?(?:nowiki|syntaxhighlight|pre|small|div|span)[^>]*>", " "), *_LINKS, (r"'''?", ""), (r"(?m)^\s*(?:From|expand=yes\|From).*$", ""), _BLANKS,
)
KINDS = {"human": (HUMAN, 401, 14000), "assisted": (ASSISTED, 251, 9000), "chat": (CHAT, 60, 9000)}


def clean(x: Column, kind: str = "human") -> Column:
    for pattern, by in KINDS[kind][0]:
        x = F.regexp_replace(x, pattern, by)
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def corpus(docs: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """Cleaned documents that are long enough, cut to the corpus's length. These limits are part of what
    the corpus is."""
    _, least, most = KINDS[kind]
    out = docs.withColumn(text_col, clean(F.col(text_col), kind))
    return out.where(F.regexp_count(text_col, F.lit(r"\S+")) >= least).withColumn(text_col, F.substring(text_col, 1, most))
