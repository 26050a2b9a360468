"""Typography and density measures, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE
from .text import WORD, has, let, word_count


#: 10, 100 and 1000 as sums of powers of two, by which a double is multiplied without an error.
_POWERS = {1: (8, 2), 2: (64, 32, 4), 3: (1024, -16, -8)}


def fixed(x: Column, places: int) -> Column:
    """Decimal rounding of a non-negative double by its exact binary value, ties up. The scaled value is a sum whose
    rounding errors are added up, so that a value just below a tie goes down, though its product would not."""

    def rounded(v: Column) -> Column:
        first, *more = _POWERS[places]
        start = F.struct((v * first).alias("s"), F.lit(0.0).alias("e"))

        def add(acc: Column, term: Column) -> Column:
            def summed(s: Column) -> Column:
                part = s - acc["s"]
                return F.struct(s.alias("s"), (acc["e"] + ((acc["s"] - (s - part)) + (term - part))).alias("e"))

            return let(acc["s"] + term, summed)

        def end(acc: Column) -> Column:
            low = F.floor(acc["s"])
            over = acc["s"] - low
            return (low + F.when((over > 0.5) | ((over == 0.5) & (acc["e"] >= 0)), 1).otherwise(0)) / float(10**places)

        return F.aggregate(F.array(*(v * m for m in more)), start, add, end)

    return let(x, rounded)


def em_dash(raw: Column) -> Column:
    words = F.greatest(word_count(raw), F.lit(1))
    total = F.regexp_count(raw, F.lit("—"))
    spaced = F.regexp_count(raw, F.lit(f"[{SPACE}]—[{SPACE}]"))
    rate = total / words * 1000
    some = F.struct(total.alias("total"), spaced.alias("spaced"), fixed(rate, 2).alias("perThousand"), fixed(spaced / total, 2).alias("spacedShare"), (rate > 3).alias("flag"))
    none = F.struct(F.lit(0).alias("total"), F.lit(0).alias("spaced"), F.lit(0.0).alias("perThousand"), F.lit(0.0).alias("spacedShare"), F.lit(False).alias("flag"))
    return F.when(has(raw, "—"), some).otherwise(none)


def quotes(raw: Column) -> Column:
    curly = F.when(has(raw, *"‘’“”"), F.regexp_count(raw, F.lit("[‘’“”]"))).otherwise(0)
    straight = F.when(has(raw, *"\"'"), F.regexp_count(raw, F.lit("[\"']"))).otherwise(0)
    mixed = (curly > 0) & (straight > 0)
    return F.struct(curly.alias("curly"), straight.alias("straight"), mixed.alias("mixed"), mixed.alias("flag"))


def _uniformity(counts: Column, name: str, least: int, bound: float, note: str | None) -> Column:
    def measured(n: Column) -> Column:
        size = F.size(n)
        mean = F.when(size > 0, F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / size)
        spread = F.when(size > 0, let(mean, lambda m: F.sqrt(F.aggregate(n, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / size) / m))
        enough = size >= least
        fields = [size.alias(name), F.when(enough, fixed(mean, 1)).alias("meanLength"), F.when(enough, fixed(spread, 3)).alias("cv"), (enough & F.coalesce(spread < bound, F.lit(False))).alias("flag")]
        if note:
            fields.append(F.when(~enough, F.lit(note)).alias("note"))
        return F.struct(*fields)

    return let(counts, measured)


def burstiness(norm: Column) -> Column:
    """Evenness of sentence lengths: sentences of more than two words, five at least."""
    flat = F.regexp_replace(norm, "\n+", " ")
    parts = F.split(flat, rf"(?<=[.!?])[{SPACE}]+", -1)
    counts = F.filter(F.transform(parts, lambda s: F.regexp_count(s, F.lit(WORD))), lambda n: n > 2)
    return _uniformity(counts, "sentences", 5, 0.35, "too few sentences")


def paragraphs(norm: Column) -> Column:
    """Evenness of paragraph lengths: paragraphs of more than 15 words, three at least."""
    parts = F.split(norm, rf"\n[{SPACE}]*\n", -1)
    counts = F.filter(F.transform(parts, lambda s: F.regexp_count(s, F.lit(WORD))), lambda n: n > 15)
    return _uniformity(counts, "paragraphs", 3, 0.25, None)


def metrics(raw: Column, norm: Column) -> Column:
    return F.struct(em_dash(raw).alias("emDash"), quotes(raw).alias("quotes"), burstiness(norm).alias("burstiness"), paragraphs(norm).alias("paragraphs"))


def bonus(m: Column) -> Column:
    """Points for flagged measures."""
    def points(flag, n):
        return F.when(flag, n).otherwise(0)

    return points(m["emDash"]["flag"], 6) + points(m["burstiness"]["flag"], 6) + points(m["paragraphs"]["flag"], 4) + points(m["quotes"]["flag"], 2)
