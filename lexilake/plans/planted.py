"""Inputs for the engine's own queries: the driver's texts hold hardly any of what the rules look for,
so each document gets one planted snippet, by id, in the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import CATEGORIES
from ..sources.files import spread, table

EXAMPLES = [e for c in CATEGORIES for p in c.patterns for e in p.examples]
TYPOGRAPHY = [
    "Plain — with a dash — and “curly” quotes, it’s \"mixed\".", "No break, thin space… and ‘single’.", "Café and क़ stay; 2′ 3″.", "All 'straight' and \"plain\".",
    "a — b — c — d — e — f", "Å is composed to one letter.", "Nothing to fold here.",
    "x —y—z " * 37 + "a — b — c — d",
    "\n\n".join(" ".join(f"{w}{'a' * (i % 7)}" for i in range(n)) + "." for w, n in (("one", 17), ("two", 19), ("three", 18), ("few", 4))) + "\n",
]
STRUCTURE = [
    "---\ntitle: x\n---\nBody of the text.", "+++\na = 1\n+++\nMore body.", "Run `vital role` and ```\nthe code\n``` end.", "Open fence ```\nnever closed, a testament", "~~~\ntilde\n~~~ after `inline` code",
    "See [label](https://example.com/a \"title\") and <http://x.org/y>.", "[ref]: https://example.com/z more\nhttp://plain.example.com/q?x=1 end", "| a | b |\n|---|---|\n| clear, concise, and compelling |", "<p class=\"x\">Text <!-- gone --> <script>var a = 1;</script> end</p>",
    "/* block */ code(); // line comment\n# hash line\nhttp://not.a/comment", "Emoji 🚀 in `co🚀de` here", "x = 1 // note: delve\n  # indented",
]
WIKITEXT = ["{{cite|a {{b}} c}} A [[link|shown]] and [[plain]].", "'''Bold''' ''it'' <ref name=\"a\"/> x <ref>gone</ref> y", "Text\n{| class\n| cell\n|}\n\n\n\nEnd [https://example.com/x name] [https://example.com/y]", "Body <b>bold</b>.\n== References ==\ntail is cut", "<!-- a\nb -->Kept."]
EXTENSIONS = [".md", ".html", ".py", ".txt", ".vue"]


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lang, source, text: the text, a blank line, an example sentence of the catalogue."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))
    return docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), pick(EXAMPLES, F.col("doc_id")), F.lit("\n")))


def before(spark: SparkSession, folder: str, values: list[str]) -> DataFrame:
    """doc_id, text: a snippet, a line end, the text."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.withColumn("text", F.concat(pick(values, F.col("doc_id")), F.lit("\n"), F.coalesce("text", F.lit(""))))
