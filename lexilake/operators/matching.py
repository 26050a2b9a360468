"""All matches of the catalogue's patterns as one array column, computed once for each document.

A pattern's regular expression runs only where a literal that its matches must hold is there; the
literals are derived from the pattern (``dialect.required``).

Two engines give the same column. ``builtin`` is made of Spark's own functions. ``arrow`` is an Arrow
function that finds all literals in one pass (Aho-Corasick, or plain searches where that library is
missing) and runs a pattern on the documents that can match: a built-in expression has to search
every text once for each literal, which measures some five times slower (README), so it is the default.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dialect, text
from .catalogue import BY_ID, CATEGORIES, STRUCTURAL, Category, Pattern

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Beyond so many literals a search for each costs more than the pattern itself.
MAX_LITERALS = 8


def views(docs: DataFrame, text_col: str = "text", masking: bool = True, composing: bool = True) -> DataFrame:
    """Adds raw, working (code masked) and norm (folded)."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("raw", raw)
    out = out.withColumn("working", text.mask_code(F.col("raw")) if masking else F.col("raw"))
    return out.withColumn("norm", text.normalize(F.col("working"), composing))


def worth(pattern: Pattern) -> Column | None:
    need = dialect.required(pattern.regex, pattern.flags)
    if not need or len(need) > MAX_LITERALS:
        return None
    return text.has(F.col("low"), *need)


def view_of(category: Category) -> Column:
    return F.col("working" if category.id in STRUCTURAL else "norm")


def pattern_surfaces(category: Category, pattern: Pattern) -> Column:
    x, test = text.surfaces(view_of(category), dialect.java(pattern.regex, pattern.flags)), worth(pattern)
    return x if test is None else F.when(test, x).otherwise(F.array().cast("array<string>"))


def pattern_spans(category: Category, pattern: Pattern) -> Column:
    return text.spans(view_of(category), dialect.java(pattern.regex, pattern.flags), worth(pattern))


HIT = "array<struct<c: int, p: int, m: string, off: int>>"


def hits(categories: Iterable[Category] = CATEGORIES) -> Column:
    """array<struct<c, p, m, off>> in catalogue order: category and pattern ordinals, match, offset."""
    order = {c.id: i for i, c in enumerate(CATEGORIES)}

    def numbered(i: int, j: int):
        return lambda s: F.struct(F.lit(i).alias("c"), F.lit(j).alias("p"), s["m"].alias("m"), s["off"].alias("off"))

    parts = []
    for c in categories:
        for j, p in enumerate(c.patterns):
            parts.append(F.transform(pattern_spans(c, p), numbered(order[c.id], j)))
    return F.flatten(F.array(*parts)) if parts else F.array().cast(HIT)


class Scanner:
    """The chosen categories' patterns for Python, behind one search for their literals."""

    #: Shorter literals are common in prose; each is looked for by itself.
    LEAST = 4

    def __init__(self, ids: Iterable[str]):
        self.patterns, self.short, words = [], [], {}
        for i, c in enumerate(CATEGORIES):
            if c.id not in ids:
                continue
            for j, p in enumerate(c.patterns):
                k = len(self.patterns)
                self.patterns.append((i, j, dialect.python(p.regex, p.flags), c.id in STRUCTURAL))
                need = dialect.required(p.regex, p.flags)
                if not need:
                    self.short.append((k, None))
                elif min(map(len, need)) < self.LEAST:
                    self.short.append((k, need))
                else:
                    for x in need:
                        words.setdefault(x, []).append(k)
        self.words = words
        self.find = None
        if ahocorasick is not None and words:
            self.find = ahocorasick.Automaton()
            for x, ks in words.items():
                self.find.add_word(x, ks)
            self.find.make_automaton()

    def scan(self, working: str, norm: str) -> list[dict]:
        low, some = norm.lower(), set()
        if working is not norm and working != norm:
            low += "\n" + working.lower()
        if self.find is not None:
            for _, ks in self.find.iter(low):
                some.update(ks)
        else:
            for x, ks in self.words.items():
                if x in low:
                    some.update(ks)
        some.update(k for k, need in self.short if need is None or any(x in low for x in need))
        out = []
        for k in sorted(some):
            i, j, regex, structural = self.patterns[k]
            out += [{"c": i, "p": j, "m": m[0], "off": m.start()} for m in regex.finditer(working if structural else norm)]
        return out


_ARROW_HIT = pa.list_(pa.struct([("c", pa.int32()), ("p", pa.int32()), ("m", pa.string()), ("off", pa.int32())]))
_HIT_TYPE = T.ArrayType(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("m", T.StringType()), T.StructField("off", T.IntegerType())]))
_scanners: dict[tuple, Scanner] = {}


def arrow_hits(ids: tuple[str, ...]) -> Column:
    """The same array as ``hits``, by the Arrow engine."""

    def scan(working: pa.Array, norm: pa.Array) -> pa.Array:
        if ids not in _scanners:
            _scanners[ids] = Scanner(ids)
        run = _scanners[ids].scan
        return pa.array([run(w, n) for w, n in zip(working.to_pylist(), norm.to_pylist())], _ARROW_HIT)

    return F.arrow_udf(scan, _HIT_TYPE)(F.col("working"), F.col("norm"))


def with_hits(docs: DataFrame, text_col: str = "text", only: Iterable[str] | None = None, masking: bool = True, composing: bool = True, engine: str = "arrow") -> DataFrame:
    """Adds the views and ``hits``."""
    wanted = None if only is None else set(only)
    chosen = [c for c in CATEGORIES if wanted is None or c.id in wanted]
    seen = views(docs, text_col, masking, composing)
    if engine == "builtin":
        return seen.withColumn("low", F.lower(F.concat("norm", F.lit("\n"), "working"))).withColumn("hits", hits(chosen)).drop("low")
    return seen.withColumn("hits", arrow_hits(tuple(c.id for c in chosen)))


def exploded(docs_with_hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each hit: id, category, pattern, match, utf16 offset, ordinal."""
    names = text.constants(c.id for c in CATEGORIES)
    ids = F.array(*(text.constants(p.id for p in c.patterns) for c in CATEGORIES))
    rows = docs_with_hits.select(id_col, "raw", F.posexplode("hits").alias("ordinal", "h"))
    return rows.select(id_col, F.element_at(names, F.col("h.c") + 1).alias("category"), F.element_at(F.element_at(ids, F.col("h.c") + 1), F.col("h.p") + 1).alias("pattern"), F.col("h.m").alias("match"), text.utf16_offset(F.col("raw"), F.col("h.off")).alias("offset"), "ordinal")


def match_category(docs: DataFrame, category_id: str, text_col: str = "text", composing: bool = True) -> DataFrame:
    """Adds ``matches`` of the category's union pattern: folded text, no masking; the whole union ignores
    case or works by lines if any member does. An unknown id is an error."""
    if category_id not in BY_ID:
        raise ValueError(f"Unknown category: {category_id}")
    union, flags = union_pattern(BY_ID[category_id])
    x = text.normalize(F.coalesce(F.col(text_col).cast("string"), F.lit("")), composing)
    return docs.withColumn("norm", x).withColumn("matches", text.spans(F.col("norm"), dialect.java(union, flags))).drop("norm")


def union_pattern(category: Category) -> tuple[str, str]:
    return "|".join(f"(?:{p.regex})" for p in category.patterns), "".join(f for f in "im" if any(f in p.flags for p in category.patterns))
