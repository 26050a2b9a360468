"""Document scores: distinct surfaces per category, capped points, measures, length factor, band."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, text
from . import matching
from .catalogue import CATEGORIES

CUT = 120
BANDS = ((65, "strong LLM register"), (35, "mixed signals"), (15, "faint traces"))
NO_BAND = "no meaningful signal"


def band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(NO_BAND)


def length_factor(words: Column) -> Column:
    return F.least(F.lit(1.6), F.greatest(F.lit(0.6), 500 / F.greatest(words, F.lit(120))))


def final_score(points: Column, factor: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(points * factor + 0.5))).cast("int")


def hits_of(hits: Column, i: int | Column) -> Column:
    return F.filter(hits, lambda h: h["c"] == i)


def shown(m: Column, cut: bool = True) -> Column:
    """The surface that a score looks at: trimmed and, in the score path, cut."""
    x = text.trim(m)
    return text.let(x, lambda y: text.first_units(y, CUT)) if cut else x


def distinct_count(hits: Column, i: int | Column, cut: bool = True) -> Column:
    return F.size(F.array_distinct(F.transform(hits_of(hits, i), lambda h: F.lower(shown(h["m"], cut)))))


def total_points(hits: Column, cut: bool = True) -> Column:
    """Points of all categories together. One expression runs over the categories that have hits: one for
    each of the twenty would take longer to plan than most texts take to score."""
    caps, weights = (F.array(*(F.lit(getattr(c, name)) for c in CATEGORIES)) for name in ("cap", "weight"))

    def points(i: Column) -> Column:
        return F.least(F.element_at(caps, i + 1), distinct_count(hits, i, cut) * F.element_at(weights, i + 1))

    present = F.array_distinct(F.transform(hits, lambda h: h["c"]))
    return F.aggregate(present, F.lit(0), lambda total, i: total + points(i))


def scored(docs: DataFrame, text_col: str = "text", only: Iterable[str] | None = None, masking: bool = True, composing: bool = True) -> DataFrame:
    """Adds to the views and hits: word_count, metrics, raw_score, score, band. Metric bonuses do not
    depend on ``only``; a text without words has factor 1."""
    only = None if only is None else list(only)
    out = matching.with_hits(docs, text_col, only, masking, composing)
    out = out.withColumn("word_count", text.word_count(F.col("norm"))).withColumn("metrics", metrics.metrics(F.col("raw"), F.col("norm")))
    out = out.withColumn("raw_score", total_points(F.col("hits")) + metrics.bonus(F.col("metrics")))
    factor = F.when(F.col("word_count") > 0, length_factor(F.col("word_count"))).otherwise(1.0)
    return out.withColumn("score", final_score(F.col("raw_score"), factor)).withColumn("band", band(F.col("score")))


def ranked_categories() -> Column:
    """The categories with hits of a scored document, in its row: ordinal, category, label, tier as severity, count,
    distinct, points, hits per 1000 words, why, caution, the first 25 hits; by points, ties in catalogue order."""
    def pick(values, i: Column) -> Column:
        return F.element_at(text.constants(values), i + 1)

    names = F.array(*(text.constants(p.id for p in c.patterns) for c in CATEGORIES))
    caps, weights = (F.array(*(F.lit(getattr(c, name)) for c in CATEGORIES)) for name in ("cap", "weight"))

    def result(i: Column) -> Column:
        of = hits_of(F.col("hits"), i)
        first = F.transform(F.slice(of, 1, 25), lambda h: F.struct(F.element_at(F.element_at(names, i + 1), h["p"] + 1).alias("pattern"), shown(h["m"]).alias("match"), text.utf16_offset(F.col("raw"), h["off"]).alias("index")))
        distinct = distinct_count(F.col("hits"), i)
        points = F.least(F.element_at(caps, i + 1), distinct * F.element_at(weights, i + 1))
        per = metrics.fixed(F.size(of) * F.when(F.col("word_count") > 0, 1000 / F.col("word_count")).otherwise(0.0), 2)
        words = {"category": "id", "label": "label", "severity": "tier"}
        notes = {"why": "why", "caution": "caution"}
        said = [[pick([getattr(c, k) for c in CATEGORIES], i).alias(name) for name, k in some.items()] for some in (words, notes)]
        return F.struct(i.alias("ordinal"), *said[0], F.size(of).alias("count"), distinct.alias("distinct"), points.alias("points"), per.alias("per1000Words"), *said[1], first.alias("hits"))

    got = F.transform(F.array_sort(F.array_distinct(F.col("hits.c"))), result)
    return F.array_sort(got, lambda a, b: F.when(a["points"] != b["points"], b["points"] - a["points"]).otherwise(a["ordinal"] - b["ordinal"]))


def category_results(scored_docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document and category with hits: what ``ranked_categories`` tells of it, and its rank."""
    # inline and not explode, for which the optimizer computes the array anew for each field asked for
    return scored_docs.select(id_col, F.inline(F.transform(ranked_categories(), lambda r, i: r.withField("rank", i.cast("int")))))


def top_hits(categories: Column) -> Column:
    """The first three hits of each category, by points, twenty at most: category, severity, match."""
    first = F.transform(categories, lambda r: F.transform(F.slice(r["hits"], 1, 3), lambda h: F.struct(r["category"].alias("category"), r["severity"].alias("severity"), h["match"].alias("match"))))
    return F.slice(F.flatten(first), 1, 20)


def reports(scored_docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each row: score, band, wordCount, categories by points, metrics, topHits. Everything stays in the
    document's row, so that null and repeated ids make no difference, and nothing is shuffled."""
    out = scored_docs.select(id_col, "score", "band", F.col("word_count").alias("wordCount"), "metrics", ranked_categories().alias("categories"))
    return out.withColumn("topHits", top_hits(F.col("categories")))
