"""Catalogue, text kernel, matching, scoring and linting on literal rows."""

import re
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexilake.functions import dialect, metrics, text
from lexilake.operators import extraction, linting, matching, rules, scoring, wikitext
from lexilake.operators.catalogue import CATEGORIES, PATTERN_INDEX, STRUCTURAL, TIERS

CLEAN = "The survey covers nine towns. Each one kept its records until the war, and some kept them later. Nobody has compared the tax rolls yet."
MACHINE = "As an AI language model, I cannot browse.\n\nThe bridge stands as a testament to craft — it's not just a bridge — it's a symbol.\n\nI hope this helps!"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def column(spark, texts, f):
    return [r[0] for r in frame(spark, texts).orderBy("doc_id").select(f(F.col("text"))).collect()]


def units(s):
    return len(s.encode("utf-16-le")) // 2


def test_catalogue_is_sound():
    assert len(CATEGORIES) == 20 and len(PATTERN_INDEX) == 95
    assert len({c.id for c in CATEGORIES}) == 20
    for c in CATEGORIES:
        assert c.tier in TIERS and c.cap >= c.weight > 0 and c.why and c.caution
        assert len({p.id for p in c.patterns}) == len(c.patterns)
        assert all(p.examples for p in c.patterns)


@pytest.mark.parametrize("key", sorted(PATTERN_INDEX))
def test_example_matches_and_holds_its_literals(key):
    p = PATTERN_INDEX[key]
    for e in p.examples:
        assert dialect.python(p.regex, p.flags).search(e)
        need = dialect.required(p.regex, p.flags)
        assert need is None or any(x in e.lower() for x in need)


def test_self_test(spark):
    rows = rules.self_test(spark).collect()
    assert len(rows) == 101 and all(r.matched for r in rows)


def test_word_boundary_is_ascii(spark):
    rows = matching.with_hits(frame(spark, ["édelve into", "delvé", "xdelve", "delve"]), only=["ai_vocabulary"]).orderBy("doc_id").collect()
    assert [len(r.hits) for r in rows] == [1, 0, 0, 1]


def test_look_ahead(spark):
    rows = matching.with_hits(frame(spark, ["Studies have shown a link.", "Studies have shown a link in 2019 already."]), only=["vague_attribution"]).orderBy("doc_id").collect()
    assert [len(r.hits) for r in rows] == [1, 0]


def test_engines_agree(spark):
    texts = [e for c in CATEGORIES for p in c.patterns for e in p.examples] + [MACHINE, CLEAN, "", "🚀 x `delve` ‘it’s’", "a\r\n## Key Takeaways\r\nb"]
    docs = frame(spark, texts)
    a, b = (matching.with_hits(docs, engine=e).select("doc_id", "hits").orderBy("doc_id").collect() for e in ("arrow", "builtin"))
    assert a == b


def test_plain_search_gives_the_same(spark, monkeypatch):
    ids = tuple(c.id for c in CATEGORIES)
    monkeypatch.setattr(matching, "ahocorasick", None)
    plain = matching.Scanner(ids)
    monkeypatch.undo()
    fast = matching.Scanner(ids)
    for c in CATEGORIES:
        for p in c.patterns:
            for e in p.examples:
                assert plain.scan(e, e) == fast.scan(e, e)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab`~\n-|[]()<>#/*é🚀:h.tps ", max_size=60))
def test_masks_by_reference(s):
    """The built-in masks' patterns keep length and line ends when applied one after another."""
    def apply(s, regex):
        return re.sub(regex, lambda m: "".join("\n" if c == "\n" else " " * units(c) for c in m[0]), s)

    out = s
    for r in (r"```[\s\S]*?(?:```|\Z)", r"~~~[\s\S]*?(?:~~~|\Z)", r"`[^`\n]*`"):
        out = apply(out, r)
    assert units(out) == units(s) and out.count("\n") == s.count("\n")


def test_length_preserved(spark):
    texts = ["a `b` ```\nc🚀\n``` d", "open ```\nnever", "~~~ x ~~~ `y`", "plain", "", "---\nt: 1\n---\nx", "[a](http://b \"t\") <http://c> http://d", "| a | b |", "<p>x<!-- y\n --></p><script>z</script>", "// c\n# d\ne /* f */"]
    for f in (text.mask_code, text.normalize, extraction.mask_front_matter, extraction.mask_urls, extraction.mask_html, extraction.mask_tables, extraction.extract_comments):
        for s, out in zip(texts, column(spark, texts, f)):
            assert units(out) == units(s), (f, s)
            assert [i for i, c in enumerate(s.encode("utf-16-le")[::2]) if c == 10] == [i for i, c in enumerate(out.encode("utf-16-le")[::2]) if c == 10]


def test_mask_code(spark):
    assert column(spark, ["a `b` c", "x ```y", "~~~q~~~z"], text.mask_code) == ["a     c", "x     ", "       z"]


def test_normalize(spark):
    got = column(spark, ["“a” ‘b’ …", "é", "Å", "a b⁠c"], text.normalize)
    assert got == ['"a" \'b\' .', "é", unicodedata.normalize("NFC", "Å"), "a b c"]


def test_positions(spark):
    s = "One.\nTwo 🙂 delve into\r\nthree delve"
    (row,) = linting.lint(frame(spark, [s]), rules={"ai_vocabulary": "warn"}).collect()
    naive = [(m.start(), s[: m.start()].count("\n") + 1, units(s[s.rfind("\n", 0, m.start()) + 1 : m.start()]) + 1) for m in re.finditer("delve", s)]
    assert [(f.line, f.column) for f in row.findings] == [(b, c) for _, b, c in naive]
    assert [f.offset for f in row.findings] == [units(s[:a]) for a, _, _ in naive]
    assert row.findings[1].text == "three delve"


def test_lead_is_left_out(spark):
    (row,) = linting.lint(frame(spark, ["It ended.  In conclusion, yes."]), rules={"ritual_conclusion": "warn"}).collect()
    (f,) = row.findings
    assert (f.match, f.column, f.endColumn) == ("In conclusion,", 12, 26)


def test_overlaps_keep_the_longest(spark):
    s = "It's not just a phone — it's a platform."
    a, b = (linting.lint(frame(spark, [s]), overlaps=o).first().findings for o in (True, False))
    assert len(a) > len(b) >= 1
    spans = [(f.offset, f.offset + units(f.match)) for f in b if f.category == "negative_parallelism"]
    assert all(x[1] <= y[0] or y[1] <= x[0] for x in spans for y in spans if x != y)
    # findings of different categories may overlap
    both = linting.lint(frame(spark, ["We delve, highlighting the x."]), rules={"ai_vocabulary": "warn"}).first().findings
    assert {f.category for f in both} == {"ai_vocabulary", "participial_tackon"}


def test_cap_comes_before_overlaps(spark):
    s = "vital role? She played a vital role. He played a key role."
    assert len(linting.lint(frame(spark, [s]), max_hits_per_rule=1).first().findings) == 1


def test_severity():
    v = linting.normalize_severity
    assert [v(x) for x in (0, "0", False, "off", 1, "1", "warning", 2, True, "error")] == ["off"] * 4 + ["warn"] * 3 + ["error"] * 3
    with pytest.raises(ValueError):
        v("loud")
    of = linting.expand_rules({"ai_vocabulary": 2})
    assert (of["tool_artifacts"], of["ai_vocabulary"], of["rule_of_three"], of["copula_avoidance"]) == ("error", "error", "off", "off")


def test_score(spark):
    machine, clean, empty = scoring.scored(frame(spark, [MACHINE, CLEAN, ""])).orderBy("doc_id").collect()
    assert machine.score > 50 and clean.score < 20
    assert (empty.score, empty.word_count, empty.band) == (0, 0, "no meaningful signal")


def test_score_counts_rules_that_are_off(spark):
    docs = frame(spark, ["delve pivotal testament intricate nuanced crucial robust"])
    assert linting.lint(docs).first().score == linting.lint(docs, rules={"ai_vocabulary": "error"}).first().score > 0


def test_null_text(spark):
    (row,) = linting.lint(frame(spark, [None])).collect()
    assert row.findings == [] and row.score == 0


def test_adversarial_is_fast(spark):
    evil = "\n".join(("not only " * 400, "a, " * 800, "**" * 900, "while " * 500, "# " * 700))
    docs = frame(spark, [evil])
    linting.lint(docs).count()
    began = time.time()
    linting.lint(docs).select("score", "findings").collect()
    assert time.time() - began < 10


def test_metrics(spark):
    m = frame(spark, ["a — b “x” 'y'"]).select(metrics.metrics(F.col("text"), F.col("text")).alias("m")).first().m
    assert (m.emDash.total, m.emDash.spaced, m.emDash.flag, m.quotes.mixed, m.burstiness.cv, m.burstiness.note) == (1, 1, True, True, None, "too few sentences")
    even = " ".join(["One two three four."] * 6)
    m = frame(spark, [even]).select(metrics.burstiness(F.col("text")).alias("m")).first().m
    assert (m.sentences, m.meanLength, m.cv, m.flag) == (6, 4.0, 0.0, True)


def test_rounding(spark):
    for v, want in ((1.45, 1.4), (8.35, 8.3), (9.15, 9.2), (10.05, 10.1)):
        assert spark.range(1).select(metrics.fixed(F.lit(v), 1)).first()[0] == want


def test_extract_prose(spark):
    docs = spark.createDataFrame([("a.py", "x = 1  # note"), ("b.md", "| a |\n<b>c</b>"), ("c.html", "<b>c</b>"), ("d", "---\nq\n---\nr"), (".md", "| a |")], "path string, text string")
    got = {r.path: (r.x.mode, r.x.text.strip()) for r in docs.select("path", extraction.extract_prose(F.col("text"), F.col("path")).alias("x")).collect()}
    assert got["b.md"] == ("markdown", "c") and got["c.html"] == ("html", "c") and got["d"] == ("text", "r")
    assert got["a.py"][0] == "comments" and got[".md"][0] == "text"


def test_summary(spark):
    docs = linting.lint(frame(spark, [MACHINE, CLEAN]), threshold=50)
    s = linting.summarize(docs).first()
    assert (s.fileCount, s.failed, s.overThreshold) == (2, True, 1) and s.errorCount > 0
    assert [x.filePath for x in linting.over_threshold(docs, F.col("doc_id").cast("string")).collect()] == ["0"]
    calm = linting.summarize(linting.quiet(linting.lint(frame(spark, ["She played a vital role."]))), 0).first()
    assert (calm.errorCount, calm.warningCount, calm.failed) == (0, 0, False)


def test_match_category(spark):
    row = matching.match_category(frame(spark, ["`delve` and DELVE"]), "ai_vocabulary").first()
    assert [m.m for m in row.matches] == ["delve", "DELVE"]
    with pytest.raises(ValueError):
        matching.match_category(frame(spark, []), "nope")


def test_report(spark):
    scored = scoring.scored(frame(spark, [MACHINE, CLEAN]))
    rows = {r.doc_id: r for r in scoring.reports(scored).collect()}
    assert rows[0].categories[0].points == max(c.points for c in rows[0].categories) and rows[0].topHits[0].category == rows[0].categories[0].category
    assert rows[1].categories == rows[1].topHits == []
    docs = spark.createDataFrame([(1, MACHINE), (1, CLEAN), (None, MACHINE), (None, "She played a vital role.")], "doc_id long, text string")
    got = [(r.doc_id, [c.category for c in r.categories], len(r.topHits) > 0) for r in scoring.reports(scoring.scored(docs)).collect()]
    own = [c.category for c in rows[0].categories]
    assert sorted(got, key=str) == sorted([(1, own, True), (1, [], False), (None, own, True), (None, ["significance_statements"], True)], key=str)


def test_wikitext(spark):
    assert column(spark, ["{{a {{b}}}}x [[l|m]] '''n'''\n== References ==\nzz"], lambda c: wikitext.clean(c, "human")) == ["x m n"]
    assert column(spark, ["{{fake heading|level=3|T}}y"], lambda c: wikitext.clean(c, "chat")) == ["### T\ny"]
    assert wikitext.corpus(frame(spark, ["short"]), "human").count() == 0


def test_structural_categories_see_unfolded_text(spark):
    assert "emoji_formatting" in STRUCTURAL
    rows = matching.with_hits(frame(spark, ["## 🚀 Start"]), only=["emoji_formatting"]).first()
    assert len(rows.hits) == 2
