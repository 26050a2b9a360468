"""Text kernel: length-preserving views, counts and offsets, all as Spark columns.

Offsets are UTF-16 units, as editors and the rule catalogue's users count them; Spark counts
code points, so a text with characters beyond U+FFFF is converted, and only such a text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import SPACE

WORD = r"[A-Za-z][A-Za-z'-]*"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: Typographic variants and what they fold to, one character for one.
FOLD_FROM = "\u2018\u2019\u201a\u201b\u2032\u201c\u201d\u201e\u201f\u2033\u00a0\u2007\u202f\u2009\u2002\u2003\u2060\u2026"
FOLD_TO = "'''''" + '"""""' + " " * 7 + "."
#: Characters that composition can change lie here; all others are left alone by it.
MAY_COMPOSE = r"[\x{300}-\x{1FFF}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{3000}-\x{D7FF}\x{F900}-\x{FFFF}\x{10000}-\x{10FFFF}]"


def utf16_length(x: Column) -> Column:
    return (F.length(x) + F.when(x.rlike(ASTRAL), F.regexp_count(x, F.lit(ASTRAL))).otherwise(0)).cast("int")


def first_units(x: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units; a character whose halves the end would part is left out."""
    sizes = F.filter(F.sequence(F.lit(n // 2), F.lit(n)), lambda k: utf16_length(F.substring(x, F.lit(1), k)) <= n)
    return F.when(x.rlike(ASTRAL), F.substring(x, F.lit(1), F.array_max(sizes))).otherwise(F.substring(x, 1, n))


def blank(x: Column) -> Column:
    """Every unit but line ends becomes a blank; a character of two units becomes two."""
    return F.regexp_replace(F.regexp_replace(x, ASTRAL, "  "), "[^\n]", " ")


def gaps(x: Column, regex: str) -> Column:
    return F.split(x, regex, -1)


def surfaces(x: Column, regex: str) -> Column:
    return F.regexp_extract_all(x, F.lit(regex), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression: what is used several times is neither written out nor
    computed several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constants(values: Iterable[str]) -> Column:
    """An array of fixed strings, given to the planner in one piece; it is folded to a literal."""
    return F.split(F.lit("\x1f".join(values)), "\x1f", -1)


def blank_spans(x: Column, regex: str, worth: Callable[[Column], Column] | None = None) -> Column:
    """Blank each match in place. ``worth``: a cheap test that spares texts without any."""

    def masked(x: Column) -> Column:
        g, m = gaps(x, regex), F.array_append(F.transform(surfaces(x, regex), blank), F.lit(""))
        out = F.array_join(F.zip_with(g, m, lambda a, b: F.concat(a, b)), "")
        return out if worth is None else F.when(worth(x), out).otherwise(x)

    return let(x, masked)


def keep_spans(x: Column, regex: str) -> Column:
    """Blank everything but the matches."""

    def masked(x: Column) -> Column:
        g, m = F.transform(gaps(x, regex), blank), F.array_append(surfaces(x, regex), F.lit(""))
        return F.array_join(F.zip_with(g, m, lambda a, b: F.concat(a, b)), "")

    return let(x, masked)


def has(x: Column, *literals: str) -> Column:
    out = F.contains(x, F.lit(literals[0]))
    for y in literals[1:]:
        out = out | F.contains(x, F.lit(y))
    return out


def mask_code(x: Column) -> Column:
    """Blank fences of backticks, then of tildes, then inline code. An open fence runs to the end."""
    for regex, mark in ((r"```[\s\S]*?(?:```|\z)", "```"), (r"~~~[\s\S]*?(?:~~~|\z)", "~~~"), (r"`[^`\n]*`", "`")):
        x = blank_spans(x, regex, lambda t, mark=mark: has(t, mark))
    return x


def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def compose(x: Column) -> Column:
    """Canonical composition where it keeps the length. Spark has no built-in for it: only texts with
    characters that it could change are sent to Python."""
    some = F.when(x.rlike(MAY_COMPOSE), x)
    done = F.pandas_udf(_composed, T.StringType())(some)
    return F.when(some.isNotNull() & (utf16_length(done) == utf16_length(x)), done).otherwise(x)


def fold(x: Column) -> Column:
    """The test first: a character map is slow, and most texts have nothing to fold."""
    return F.when(x.rlike(f"[{FOLD_FROM}]"), F.translate(x, FOLD_FROM, FOLD_TO)).otherwise(x)


def normalize(x: Column, composing: bool = True) -> Column:
    """Fold typographic variants, length kept. ``composing=False`` leaves out composition, for
    callers whose text is known to be composed."""
    return fold(compose(x) if composing else x)


def trim(x: Column) -> Column:
    """Spark's trim knows U+0020 alone."""
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD))


def spans(x: Column, regex: str, worth: Column | None = None) -> Column:
    """array<struct<m, off>>: all matches with their offsets in code points, from the alternation of
    gaps and matches. The gaps are only cut where there is a match."""
    none = F.array().cast("array<struct<m: string, off: int>>")

    def placed(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            def at(s: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(g, F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y))
                return F.struct(s.alias("m"), (before + F.aggregate(F.slice(m, F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y))).alias("off"))

            return F.transform(m, at)

        return F.when(F.size(m) > 0, let(gaps(x, regex), with_gaps)).otherwise(none)

    found = let(surfaces(x, regex), placed)
    return found if worth is None else F.when(worth, found).otherwise(none)


def line_of(x: Column, offset: Column) -> Column:
    """1-based line of a code-point offset; only U+000A ends a line."""
    before = F.substring(x, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(x: Column, offset: Column) -> Column:
    """1-based column in UTF-16 units."""
    before = F.element_at(F.split(F.substring(x, F.lit(1), offset), "\n", -1), -1)
    return utf16_length(before) + 1


def utf16_offset(x: Column, offset: Column) -> Column:
    return utf16_length(F.substring(x, F.lit(1), offset))


def line_text(x: Column, line: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(x, "\n", -1), line), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot of the base name is none."""
    base = F.element_at(F.split(path, "/", -1), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))
