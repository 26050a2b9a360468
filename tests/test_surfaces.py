"""Configuration, files, reports, request batches, corpus analytics, streams."""

import json
import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from test_engine import CLEAN, MACHINE

from lexilake.functions import metrics, text
from lexilake.operators import linting, scoring
from lexilake.plans import api, config, corpus
from lexilake.sources import files, sinks
from lexilake.streaming import stream


def test_globs():
    import re

    def ok(glob, path):
        return bool(re.search(files.glob_regex(glob), path))

    assert ok("**/*.md", "a/b/c.md") and ok("**/*.md", "c.md") and not ok("*.md", "a/c.md")
    assert ok("a/{b,c*}.txt", "a/cd.txt") and ok("f[0-9]?.x", "f1z.x") and not ok("f[0-9].x", "fa.x")
    assert ok("a+b", "a+b") and ok("{x", "{x") and ok("[x", "[x") and ok("src/**", "src/a/b")
    assert files.is_literal("a/b") and not files.is_literal("a/*")


def test_expand(tmp_path):
    for name in ("a.md", "b.txt", "sub/c.md", "node_modules/d.md", "sub/e.py"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    d = config.DEFAULTS

    def names(patterns):
        return [p[len(str(tmp_path)) + 1 :] for p in files.expand(patterns, tmp_path, d["include"], d["exclude"])]

    assert names(["**/*.md"]) == ["a.md", "sub/c.md"]
    assert names(["."]) == ["a.md", "b.txt", "sub/c.md"]
    assert names(["sub/e.py", "missing.md", "sub"]) == ["sub/c.md", "sub/e.py"]


def test_whole_texts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("one\ntwo")
    (tmp_path / "CHANGELOG.md").write_text("no")
    (tmp_path / "b.py").write_text("no")
    rows = files.whole_texts(spark, str(tmp_path)).collect()
    assert [(r.path, r.text) for r in rows] == [("x/a.md", "one\ntwo")]


def test_corpus_json(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"id": "a", "text": "t"}, {"id": "b", "text": "u", "date": "2017"}], indent=1))
    assert [tuple(r) for r in files.corpus_json(spark, str(p), "ai").orderBy("doc_id").collect()] == [("ai", "a", "t", None), ("ai", "b", "u", "2017")]


def test_config(tmp_path):
    sub = tmp_path / "sub"
    sub.mkdir()
    (tmp_path / ".lexilakerc.json").write_text('{"threshold": 30, "rules": {"ai_vocabulary": 1}}')
    got, source = config.resolve(config.Flags(threshold=40, only=["ai_vocabulary", "copula_avoidance"], rules={"rule_of_three": "error", "business_jargon": "warn"}, min_tier="medium"), sub)
    assert source.endswith(".lexilakerc.json") and got["threshold"] == 40
    assert got["rules"]["rule_of_three"] == "error" and got["rules"]["business_jargon"] == "off" and got["rules"]["ai_vocabulary"] == "off"
    (sub / "package.json").write_text('{"lexilake": {"rules": {"nope": 1}}}')
    with pytest.raises(config.ConfigError, match="nope"):
        config.resolve(None, sub)
    assert config.resolve(config.Flags(no_config=True), sub)[0]["threshold"] is None
    (sub / "package.json").write_text("{broken")
    assert config.resolve(None, sub)[0]["threshold"] == 30
    for bad in ({"threshold": 101}, {"threshold": "x"}, {"format": "xml"}, {"rules": {"ai_vocabulary": "loud"}}):
        with pytest.raises(config.ConfigError):
            config.validate(bad, "here")
    for flags in (config.Flags(only=["x"]), config.Flags(rules={"x": "off"}), config.Flags(min_tier="x"), config.Flags(config="missing.json")):
        with pytest.raises(config.ConfigError):
            config.resolve(flags, sub)
    (sub / ".otherrc").write_text('{"threshold": 7}')
    assert config.resolve(None, sub, names=(".otherrc",), package_key="other")[0]["threshold"] == 7
    path = config.write_starter(sub)
    assert config.load(path)["threshold"] == 45
    with pytest.raises(config.ConfigError):
        config.write_starter(sub)


@pytest.fixture(scope="module")
def linted(spark):
    docs = spark.createDataFrame([("a,b.md", MACHINE), ("c.md", CLEAN)], "path string, text string")
    return linting.lint(docs, threshold=50).cache()


def test_reports(linted):
    summary = linting.summarize(linted).first()
    found = json.loads(sinks.json_report(linted, summary))
    assert found["summary"]["files"] == 2 and found["summary"]["failed"] and len(found["results"]) == 2
    assert set(found["results"][0]["findings"][0]) == set(sinks.FINDING_FIELDS)
    sarif = json.loads(sinks.sarif_report(linted))["runs"][0]
    assert len(sarif["tool"]["driver"]["rules"]) == 20 and sarif["results"][0]["ruleId"] == "ai_self_reference"
    lines = sinks.github_report(linted, summary).split("\n")
    assert lines[0].startswith("::error file=a%2Cb.md,line=1,col=1,") and "Score threshold" in lines[-2] and lines[-1].startswith("::notice")
    pretty = sinks.pretty_report(linted, summary, verbose=True)
    assert "a,b.md  score" in pretty and "c.md" not in pretty and "sentence CV n/a" in pretty


def test_write_lines(linted, tmp_path):
    sinks.write_lines(sinks.json_lines(linted), str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and all(json.loads(x)["wordCount"] for x in lines)


REQUESTS = [
    ("get", "/health", None, 200, None), ("GET", "//v1//rules/", None, 200, None), ("GET", "/x", None, 404, "not_found"), ("OPTIONS", "/anything", None, 204, None), ("PUT", "/v1/lint", "{}", 405, "method_not_allowed"),
    ("POST", "/v1/x", "{}", 404, "not_found"), ("POST", "/v1/lint", "{oops secret", 400, "invalid_json"), ("POST", "/v1/lint", "[1]", 400, "invalid_body"), ("POST", "/v1/lint", None, 400, "missing_text"),
    ("POST", "/v1/lint", '{"text": 5}', 400, "missing_text"), ("POST", "/v1/lint", '{"text": " \\n"}', 400, "empty_text"), ("POST", "/v1/lint", json.dumps({"text": "x" * 200_001}), 413, "text_too_large"),
    ("POST", "/v1/lint", json.dumps({"text": "x" * 600_000}), 413, "body_too_large"), ("POST", "/v1/lint", '{"text": "a", "threshold": 101}', 400, "invalid_threshold"), ("POST", "/v1/lint", '{"text": "a", "threshold": "5"}', 400, "invalid_threshold"),
    ("POST", "/v1/lint", '{"text": "a", "maxHitsPerRule": -1}', 400, "invalid_max_hits"), ("POST", "/v1/lint", '{"text": "a", "rules": {"ai_vocabulary": "loud", "nope": 1}}', 400, "invalid_rules"),
    ("POST", "/v1/lint", '{"text": "a", "rules": {"nope": "loud"}}', 400, "unknown_rule"), ("POST", "/v1/score", '{"text": "We delve.", "threshold": null}', 200, None),
]


def test_request_codes(spark):
    rows = spark.createDataFrame([(i, m, p, b) for i, (m, p, b, _, _) in enumerate(REQUESTS)], "request_id int, method string, path string, body string")
    got = {r.request_id: r for r in api.responses(rows).collect()}
    assert [(got[i].status, got[i].code) for i in range(len(REQUESTS))] == [(s, c) for *_, s, c in REQUESTS]
    assert not any("secret" in str(tuple(r)) for r in got.values() if r.code)


def test_request_options(spark):
    body = {"text": "We delve and delve.\n| delve | x |", "filePath": "a.md", "extract": True, "rules": {"ai_vocabulary": "error"}, "maxHitsPerRule": 1, "threshold": 1}
    rows = spark.createDataFrame([(1, "POST", "/v1/lint", json.dumps(body)), (2, "POST", "/v1/lint", json.dumps(body | {"extract": False, "maxHitsPerRule": 0, "rules": {}}))], "request_id int, method string, path string, body string")
    one, two = (json.loads(r.response) for r in api.responses(rows).orderBy("request_id").collect())
    assert [f["severity"] for f in one["results"][0]["findings"]] == ["error"] and one["summary"]["overThreshold"][0]["filePath"] == "a.md" and one["results"][0]["metrics"]["burstiness"]["cv"] is None
    assert two["results"][0]["findings"] == []


def test_rate_limit(spark):
    times = [0, 10, 20, 60, 61, 65, 90, 90]
    log = spark.createDataFrame([("a", t) for t in times] + [("b", 5)], "ip string, t long").select("ip", F.timestamp_seconds("t").alias("ts"))
    got = [r.admitted for r in api.rate_limited(log, 2).where("ip = 'a'").orderBy("ts").collect()]
    want, kept = [], []
    for t in times:
        kept = [x for x in kept if x > t - 60]
        want.append(len(kept) < 2)
        kept += [t] if want[-1] else []
    assert got == want


def test_get_bodies(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(("/", "/health", "/v1/rules/", "/openapi.json", "/x"))], "request_id int, path string").withColumn("method", F.lit("GET")).withColumn("body", F.lit(None).cast("string"))
    got = {r.request_id: (r.status, r.response and json.loads(r.response)) for r in api.responses(rows).collect()}
    assert [got[i][0] for i in range(5)] == [200, 200, 200, 200, 404] and got[4][1] is None
    assert got[1][1]["categories"] == 20 and got[1][1]["patterns"] == 95 and len(got[2][1]["rules"]) == 20
    assert set(got[3][1]["paths"]) == {"/health", "/v1/rules", "/v1/lint", "/v1/score"} and "POST /v1/lint" in got[0][1]["routes"]


def test_percent_and_fixed(spark):
    """As 100 * a / b and as decimal rounding of the exact binary value."""
    pairs = [(a, b) for b in range(1, 200) for a in range(b + 1)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", corpus.percent("a", "b").alias("p"), *(metrics.fixed(F.col("a") / F.col("b"), n).alias(f"f{n}") for n in (1, 2, 3))).collect()
    for r in rows:
        assert r.p == math.floor(100 * r.a / r.b + 0.5)
        for n in (1, 2, 3):
            assert r[f"f{n}"] == float(Decimal(r.a / r.b).quantize(Decimal(10) ** -n, ROUND_HALF_UP)), (r.a, r.b, n)
    assert spark.range(1).select(corpus.percent(F.lit(1), F.lit(0))).first()[0] is None


def test_units_are_cut_between_characters(spark):
    for x in ("a" * 70, "🚀" * 40, "a" + "🚀" * 40, "ab🚀"):
        cut = spark.range(1).select(text.first_units(F.lit(x), 59)).first()[0]
        want = x
        while len(want.encode("utf-16-le")) > 118:
            want = want[:-1]
        assert cut == want


def test_distribution(spark):
    scores = {"x": [3, 9, 1, 50, 7, 7], "y": [5]}
    docs = spark.createDataFrame([(k, s) for k, v in scores.items() for s in v], "corpus string, score int")
    rows = {r.corpus: r for r in corpus.distribution(docs).collect()}
    for k, v in scores.items():
        s = sorted(v)
        want = [s[min(len(s) - 1, int(p * len(s)))] for p in (0.5, 0.25, 0.75)]
        assert [rows[k].median, rows[k].p25, rows[k].p75] == want and rows[k].n == len(s)
    assert rows["x"]["mean"] == 12.8
    assert corpus.distribution(docs.limit(0)).count() == 0


def test_sweep_without_flags(spark):
    docs = spark.createDataFrame([(1, 10), (0, 5)], "y int, score int")
    rows = corpus.sweep(docs, F.col("y") == 1, F.col("y") == 0, (7, 90)).orderBy("threshold").collect()
    assert [(r.recall, r.fpr, r.precision) for r in rows] == [(100, 0, 100), (0, 0, None)]


def test_lift(spark):
    docs = spark.createDataFrame([(1, "ai", MACHINE), (2, "human", CLEAN), (3, "human", "She played a vital role " + CLEAN)], "doc_id int, corpus string, text string")
    rows = {r.category: r for r in corpus.lift(scoring.scored(docs)).collect()}
    assert rows["ai_self_reference"].lift == float("inf") and rows["emoji_formatting"].lift == 0
    assert rows["significance_statements"].lift > 0


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, MACHINE), (2, CLEAN)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    source = stream.documents(spark, str(tmp_path / "in"), docs.schema, "*.parquet")
    stream.run_to_end(stream.findings(source), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = linting.findings_table(linting.lint(docs))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["doc_id", "word_count", "score", "band"] and rows.count() == 200
