"""Corpus analytics over scored documents: distributions, sweeps, lift, extremes, typography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.metrics import fixed
from ..operators import scoring
from ..operators.catalogue import CATEGORIES

THRESHOLDS = (15, 25, 35, 45, 55, 65, 75)


def distribution(scored: DataFrame, corpus: str = "corpus") -> DataFrame:
    """n, mean, min, max and nearest-rank quantiles (element min(n - 1, floor(p * n)) of the sorted
    scores). Scores are whole numbers from 0 to 100, so a histogram holds all there is: no group of
    scores is gathered anywhere."""
    hist = scored.groupBy(corpus, "score").agg(F.count("*").alias("k"))
    up_to = Window.partitionBy(corpus).orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("cum", F.sum("k").over(up_to)).withColumn("n", F.sum("k").over(Window.partitionBy(corpus)))

    def quantile(p: float) -> Column:
        rank = F.least(F.col("n") - 1, F.floor(F.col("n") * p))
        return F.min(F.when(F.col("cum") > rank, F.col("score")))

    mean = fixed(F.sum(F.col("score") * F.col("k")) / F.sum("k"), 1)
    return hist.groupBy(corpus).agg(F.sum("k").alias("n"), mean.alias("mean"), quantile(0.5).alias("median"), F.min("score").alias("min"), F.max("score").alias("max"), quantile(0.25).alias("p25"), quantile(0.75).alias("p75"))


def percent(part, whole) -> Column:
    """100 * part / whole, rounded; null for a whole of zero. The product comes first: it is exact."""
    return F.floor(F.try_divide(100 * (F.col(part) if isinstance(part, str) else part), whole) + 0.5).cast("int")


def sweep(scored: DataFrame, positive: Column, negative: Column, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """One row for each threshold: true and false positives, sizes, recall, false-positive rate and
    precision in per cent (null where nothing is flagged). All counts come from one aggregation."""
    columns = [F.count_if(positive).alias("positives"), F.count_if(negative).alias("negatives")]
    columns += [F.array(*(F.count_if(side & (F.col("score") >= t)) for t in thresholds)).alias(name) for side, name in ((positive, "tp"), (negative, "fp"))]
    rows = scored.agg(*columns).select("positives", "negatives", F.posexplode(F.arrays_zip(F.array(*map(F.lit, thresholds)).alias("threshold"), "tp", "fp")).alias("k", "r"))
    rows = rows.select(F.col("r.threshold").alias("threshold"), F.col("r.tp").alias("tp"), "positives", F.col("r.fp").alias("fp"), "negatives")
    return rows.withColumn("recall", percent("tp", "positives")).withColumn("fpr", percent("fp", "negatives")).withColumn("precision", percent("tp", F.col("tp") + F.col("fp")))


def per_category(scored: DataFrame, corpus: str = "corpus") -> DataFrame:
    """One row for each category and corpus: share of documents with a hit, hits per 1000 words."""
    counts = [F.size(F.filter("hits", lambda_of(i))).alias(f"c{i}") for i in range(len(CATEGORIES))]
    wide = scored.select(corpus, "word_count", *counts)
    aggregates = [F.count("*").alias("docs"), F.sum("word_count").alias("words")]
    for i in range(len(CATEGORIES)):
        aggregates += [F.sum(f"c{i}").alias(f"h{i}"), F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}")]
    wide = wide.groupBy(corpus).agg(*aggregates)
    cells = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(c.id).alias("category"), F.lit(c.tier).alias("tier"), F.col(f"h{i}").alias("hits"), F.col(f"d{i}").alias("with_hit")) for i, c in enumerate(CATEGORIES)))
    rows = wide.select(corpus, "docs", "words", F.explode(cells).alias("c")).select(corpus, "docs", "words", "c.*")
    return rows.withColumn("doc_pct", percent("with_hit", "docs")).withColumn("per1k", F.coalesce(fixed(F.try_divide(F.col("hits") * 1000, F.col("words")), 2), F.lit(0.0)))


def lambda_of(i: int):
    return lambda h: h["c"] == i


def lift(scored: DataFrame, corpus: str = "corpus", names: tuple = ("ai", "chat", "human")) -> DataFrame:
    """One row for each category with the corpora side by side. Lift is the ratio of the rounded
    densities of the first and the last corpus; infinite where the last has none and another has some."""
    ai, chat, human = names
    rows = per_category(scored, corpus)

    def pick(name, column):
        return F.coalesce(F.max(F.when(F.col(corpus) == name, F.col(column))), F.lit(0))

    wide = rows.groupBy("ordinal", "category", "tier").agg(*(pick(n, c).alias(f"{n}_{c}") for n in names for c in ("doc_pct", "per1k")))
    some = (F.col(f"{ai}_per1k") > 0) | (F.col(f"{chat}_per1k") > 0)
    ratio = F.when(F.col(f"{human}_per1k") > 0, fixed(F.try_divide(f"{ai}_per1k", f"{human}_per1k"), 1)).when(some, F.lit(float("inf"))).otherwise(0.0)
    return wide.withColumn("lift", ratio).orderBy(F.desc("lift"), "ordinal")


def extremes(scored: DataFrame, k: int = 5, highest: bool = True, id_col: str = "doc_id") -> DataFrame:
    """The k documents of highest or lowest score, ties by id, with their three best categories: id, count and an example
    of at most 70 units."""
    order = F.desc("score") if highest else F.asc("score")
    top = scored.orderBy(order, id_col).limit(k)
    if "hits" not in scored.columns:
        return top
    best = F.slice(scoring.ranked_categories(), 1, 3)
    said = F.transform(best, lambda c: F.struct(c["category"].alias("category"), c["count"].alias("count"), text.first_units(c["hits"][0]["match"], 70).alias("example")))
    return top.withColumn("categories", said)


def typography(scored: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Em dashes per 1000 words (a ratio of sums) and mean sentence-length variation, per corpus."""
    dashes = fixed(F.try_divide(F.sum("metrics.emDash.total") * 1000, F.sum("word_count")), 2)
    return scored.groupBy(corpus).agg(dashes.alias("em_dashes"), fixed(F.avg("metrics.burstiness.cv"), 3).alias("mean_cv"))
