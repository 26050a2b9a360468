"""License scans by canonical digest lookup. DataFrame functions only on the main path.

A text's canonical form drops copyright lines (in one form every line that begins with the word or sign, as in the
digests of long licences, in another, looked up too, only statements with a sign or year), turns every run of characters other than letters
and digits into one blank, lower-cases, and replaces equivalent spellings. Entire texts are
compared by the digest of that form: the whole document, and each of its lines taken as a text of its
own (short notices stand on a line). Digests are hash-joined with those of known licences.

Known licences are a table (license_id, text, digest) of at most ``MAX_KNOWN`` rows; the operator checks
that bound before it broadcasts their digests and leaves the join to the planner beyond it. Where each known
licence also names an ``anchor``, a string that its lower-cased text and its canonical form hold in every spelling, texts and lines
without any anchor cannot match and are spared the canonical form; the operator checks the anchors of known
texts, and does without if one is missing, wrong, or if there are more than ``MAX_ANCHORS``.

Defined results: null or empty texts, and texts or lines without letters or digits, match nothing; ids
are carried as they are, repeated ids share the union of their rows' licences; the result has one row
per input row. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KNOWN = 20000
MAX_ANCHORS = 8

#: Equivalent spellings, after lower-casing: whole words, first form replaced by the second.
#: Fixed values, after the matching guidelines that public licence lists describe.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("authorization", "authorisation"), ("catalog", "catalogue"),
    ("favor", "favour"), ("fulfill", "fulfil"), ("fulfillment", "fulfilment"),
    ("honor", "honour"), ("initialize", "initialise"), ("judgment", "judgement"), ("labor", "labour"),
    ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"), ("licensing", "licencing"), ("noncommercial", "non commercial"),
    ("organization", "organisation"), ("recognize", "recognise"), ("sublicense", "sublicence"), ("utilization", "utilisation"),
)

#: Equivalent phrases, in the forms that the replaced words give.
PHRASES = (("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("per cent", "percent"), ("sub licence", "sublicence"))

COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:[Cc]opyright|COPYRIGHT|\([Cc]\)|©)[^\n]*$"
#: Copyright statements alone: the word or sign with a sign, a year or a place for one, up to the line's end or a notice.
COPYRIGHT_STATEMENT = (
    r"(?m)^[ \t#*/;-]*(?:(?:[Cc]opyright|COPYRIGHT)[ \t:,]*(?:\([Cc]\)|©|[0-9]{4}|[\[<{])|(?:\([Cc]\)|©)[ \t]*(?:[Cc]opyright|COPYRIGHT|[0-9]{4}|[\[<{])|©)"
    r"[^\n]*?(?=$|\b(?:Released|Licen[sc]ed|SPDX-License-Identifier|This work|Permission)\b)"
)
COPYRIGHT_SIGNS = ("opyright", "COPYRIGHT", "(C)", "(c)", "©")
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _signed(text: Column) -> Column:
    """Whether a text can hold a copyright line: plain searches spare most texts the line-wise patterns."""
    sign = F.lit(False)
    for x in COPYRIGHT_SIGNS:
        sign = sign | F.contains(text, F.lit(x))
    return sign


def _words(text: Column, dropped: str = COPYRIGHT_LINE) -> Column:
    """Lower-cased words, lines kept, with single words spelt one way: each line begins and ends with
    a blank. The classes mean the same in other SQL engines."""
    body = F.when(_signed(text), F.regexp_replace(text, dropped, "")).otherwise(text)
    form = F.lower(F.regexp_replace(body, NOT_WORD, " "))
    form = F.concat(F.lit(" "), F.replace(form, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for a, b in SPELLINGS:
        form = F.replace(form, F.lit(f" {a} "), F.lit(f" {b} "))
    return form


def _form(words: Column, one_line: bool = False) -> Column:
    """One text's canonical form from its words. Within one line blanks are single already."""
    form = F.concat(F.lit(" "), F.trim(words), F.lit(" ")) if one_line else F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), "[ \n]+", " ")
    for a, b in PHRASES:
        form = F.replace(form, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(form)


def canonical(text: Column, dropped: str = COPYRIGHT_LINE) -> Column:
    return _form(_words(text, dropped))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id), one row for each distinct canonical form: the smallest id wins a tie.
    Rows of ``known`` have a text or, where the text is long, the digest of its canonical form."""
    forms = F.array_distinct(F.array(canonical(F.col("text")), canonical(F.col("text"), COPYRIGHT_STATEMENT)))
    rows = known.select("license_id", F.explode(forms).alias("c"), "digest")
    rows = rows.where("digest IS NOT NULL OR c != ''")
    return rows.groupBy(F.coalesce("digest", F.sha2("c", 256)).alias("digest")).agg(F.min("license_id").alias("license_id"))


def anchors_of(known: DataFrame) -> list[str]:
    """The distinct anchors, if every known licence has one and they are few; else none."""
    if "anchor" not in known.columns:
        return []
    wrong = F.col("anchor").isNull() | (F.col("text").isNotNull() & ~(F.contains(F.lower("text"), "anchor") & F.contains(canonical(F.col("text")), "anchor")))
    got = known.agg(F.count_if(wrong).alias("wrong"), F.slice(F.sort_array(F.collect_set("anchor")), 1, MAX_ANCHORS + 1).alias("anchors")).first()
    return [] if got.wrong or len(got.anchors) > MAX_ANCHORS else got.anchors


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_license (of the whole text, else null),
    line_licenses (sorted distinct ids of its lines, joined with commas, empty without any),
    n_license_lines (lines that matched).

    One pass makes the words of a text; the whole and its lines become rows with a digest, of which
    only those that find a licence go through a shuffle."""
    digests = known_digests(known)
    if known.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN:
        digests = F.broadcast(digests)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    anchors = anchors_of(known)

    def held(x: Column) -> Column:
        out = F.lit(not anchors)
        for a in anchors:
            out = out | F.contains(x, F.lit(a))
        return out

    if anchors:
        rows = rows.where(held(F.lower("text")))
    # every step below is an attribute once, and no filter stands on a computed column: it would be computed again
    words = rows.select("id", _words(F.col("text")).alias("words"), F.when(_signed(F.col("text")), _words(F.col("text"), COPYRIGHT_STATEMENT)).alias("signed"))
    whole = F.struct(F.lit(True).alias("whole"), _form(F.col("words")).alias("form"))
    other = F.struct(F.lit(True).alias("whole"), _form(F.col("signed")).alias("form"))
    lines = F.transform(F.filter(F.split(F.coalesce("signed", "words"), "\n"), held), lambda x: F.struct(F.lit(False).alias("whole"), _form(x, True).alias("form")))
    parts = words.select("id", F.inline(F.concat(F.when(F.col("signed").isNull(), F.array(whole)).otherwise(F.array(whole, other)), lines)))
    # a form without words has no known digest
    found = parts.select("id", "whole", F.sha2("form", 256).alias("digest")).join(digests, "digest")
    line = F.when(~F.col("whole"), F.col("license_id"))
    found = found.groupBy("id").agg(F.min(F.when(F.col("whole"), F.col("license_id"))).alias("text_license"), F.count(line).alias("n"), F.array_join(F.array_sort(F.collect_set(line)), ",").alias("names"))
    out = ids.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", "text_license", F.coalesce("names", F.lit("")).alias("line_licenses"), F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"))
