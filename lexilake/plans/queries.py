"""One query for each operator of the rule engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import extraction, linting, matching, rules, scoring, wikitext
from ..operators.catalogue import BY_ID, CATEGORIES
from ..sources import files, sinks
from ..streaming import stream
from . import api, corpus, planted

Query = Callable[[SparkSession, str], DataFrame]
USER_RULES = {"ai_vocabulary": "warn", "tool_artifacts": "off", "rule_of_three": "error", "formatting_tells": 2}
GLOBS = {"md": ["**/*.md"], "site": ["site/*/p?*.{html,md}"], "digit": ["site/[0-3]/**"], "skip": ["**/6/**", "**/*.min.*"]}
SWEPT = (5, 10, 15, 25, 35, 45, 55, 65, 75)


def _sha(x):
    return F.sha2(F.encode(x, "UTF-8"), 256)


def _masked(values: list[str], mask) -> Query:
    def query(spark, d):
        docs = planted.before(spark, d, values)
        return docs.select("doc_id", mask(F.col("text")).alias("m")).select("doc_id", _sha(F.col("m")).alias("sha"), text.utf16_length(F.col("m")).alias("units"))

    return query


def word_count(spark, d):
    return matching.views(planted.documents(spark, d)).select("doc_id", text.word_count(F.col("norm")).alias("words"))


def normalize(spark, d):
    docs = matching.views(planted.before(spark, d, planted.TYPOGRAPHY), masking=False)
    return docs.select("doc_id", _sha(F.col("norm")).alias("sha"), text.utf16_length(F.col("norm")).alias("units"))


def mask_html(spark, d):
    pages = files.spread(files.table(spark, d, "pages").select("page_id", "html"))
    m = extraction.mask_html(F.coalesce("html", F.lit("")))
    return pages.select("page_id", m.alias("m")).select("page_id", _sha(F.col("m")).alias("sha"), text.word_count(F.col("m")).alias("words"))


def extract_prose(spark, d):
    docs = planted.before(spark, d, planted.STRUCTURE)
    path = F.concat(F.lit("dir/f"), F.col("doc_id"), planted.pick(planted.EXTENSIONS, F.col("doc_id")))
    return docs.select("doc_id", extraction.extract_prose(F.col("text"), path).alias("x")).select("doc_id", "x.mode", _sha(F.col("x.text")).alias("sha"))


def is_lintable(spark, d):
    pages = files.table(spark, d, "pages")
    path = F.concat(F.lit("a.b/"), F.col("page_id"), planted.pick([".MD", ".rst", ".exe", "", ".tar.gz", ".svelte", ".yml"], F.col("page_id")))
    return pages.select("page_id", path.alias("path"), extraction.is_lintable(path).alias("lintable"))


def _metric(name: str, fields: list[str]) -> Query:
    def query(spark, d):
        docs = matching.views(planted.before(spark, d, planted.TYPOGRAPHY))
        x = metrics.metrics(F.col("raw"), F.col("norm"))[name]
        return docs.select("doc_id", x.alias("x")).select("doc_id", *(F.col(f"x.{f}").alias(f) for f in fields))

    return query


def _hits(category: str) -> Query:
    def query(spark, d):
        docs = matching.with_hits(planted.documents(spark, d), only=[category])
        ids = F.array(*(F.lit(p.id) for p in BY_ID[category].patterns))

        def of_pattern(j):
            own = F.filter("hits", lambda h: h["p"] == j)
            return F.struct(F.element_at(ids, j + 1).alias("pattern"), F.size(own).cast("long").alias("n"), own[0]["off"].alias("first_offset"), own[0]["m"].alias("first_match"))

        # counted in the row; inline of an expression, since below an exploded column the optimizer computes it twice
        return docs.select("doc_id", F.inline(F.transform(F.array_distinct("hits.p"), of_pattern)))

    return query


def match_category(spark, d):
    docs = matching.match_category(planted.documents(spark, d), "negative_parallelism", composing=True)
    return docs.where(F.size("matches") > 0).select("doc_id", F.size("matches").alias("n"), F.col("matches")[0]["m"].alias("first_match"), F.col("matches")[0]["off"].alias("first_offset"))


def _scored(spark, d):
    return scoring.scored(planted.documents(spark, d))


def score(spark, d):
    return _scored(spark, d).select("doc_id", "word_count", "score", "band")


def band(spark, d):
    return _scored(spark, d).groupBy("band").agg(F.count("*").alias("docs"))


def score_only(spark, d):
    docs = scoring.scored(planted.documents(spark, d), only=["ai_vocabulary", "rule_of_three"])
    return docs.select("doc_id", "score", "band")


def category_points(spark, d):
    return scoring.category_results(_scored(spark, d)).select("doc_id", "rank", "category", "count", "distinct", "points", "per1000Words")


def _numbered(values):
    return F.inline(F.transform(values, lambda h, i: F.struct(i.cast("int").alias("rank"), h["category"].alias("category"), h["severity"].alias("severity"), h["match"].alias("match"))))


def top_hits(spark, d):
    return scoring.reports(_scored(spark, d)).select("doc_id", _numbered(scoring.top_hits(F.col("categories"))))


def reports(spark, d):
    """Whole reports, of rows whose ids repeat or are null."""
    docs = _scored(spark, d).withColumn("doc_id", F.nullif(F.col("doc_id") - F.pmod("doc_id", F.lit(3)), F.lit(0)))
    best = F.array_join(F.transform("categories", lambda c: F.concat_ws(":", c["category"], c["count"], c["distinct"], c["points"])), ",")
    top = F.array_join(F.transform("topHits", lambda h: F.concat_ws(":", h["category"], h["severity"], h["match"])), "|")
    return scoring.reports(docs).select("doc_id", "score", "band", "wordCount", best.alias("categories"), F.sha2(F.encode(top, "UTF-8"), 256).alias("top_sha"))


def _linted(spark, d, **options):
    return linting.lint(planted.documents(spark, d), rules={"ai_vocabulary": "warn", "copula_avoidance": "warn", "rule_of_three": "warn"}, **options)


FINDING_COLUMNS = ("doc_id", "line", "column", "endColumn", "offset", "ruleId", "severity", "match", "message", "text")


def positions(spark, d):
    return linting.findings_table(_linted(spark, d, overlaps=True)).select(*FINDING_COLUMNS)


def findings(spark, d):
    return linting.findings_table(_linted(spark, d)).select(*FINDING_COLUMNS)


def max_hits(spark, d):
    return linting.findings_table(_linted(spark, d, max_hits_per_rule=1, overlaps=True)).select(*FINDING_COLUMNS)


def lint_counts(spark, d):
    return _linted(spark, d, threshold=15).select("doc_id", "score", "errorCount", "warningCount", "thresholdExceeded")


def summarize(spark, d):
    out = linting.summarize(_linted(spark, d, threshold=25), 10)
    return out.select("fileCount", "errorCount", "warningCount", F.col("overThreshold").alias("over"), "maxWarnings", "failed")


def over_threshold(spark, d):
    return linting.over_threshold(_linted(spark, d, threshold=25), F.col("doc_id").cast("string"))


def quiet(spark, d):
    return linting.quiet(_linted(spark, d)).agg(F.sum(F.size("findings")).alias("findings"), F.sum("errorCount").alias("errors"), F.sum("warningCount").alias("warnings"))


def severity_resolve(spark, d):
    return rules.resolved(spark, USER_RULES)


def rules_list(spark, d):
    return rules.rules_table(spark).select("id", "label", "tier", "defaultSeverity", F.array_join("patterns", ",").alias("patterns"))


def pattern_index(spark, d):
    return rules.patterns_table(spark).select("key", "flags", "vendor", "era", F.size("examples").alias("examples"))


def health(spark, d):
    return rules.health(spark)


def self_test(spark, d):
    return rules.self_test(spark)


def _corpora(spark, d):
    names = F.when(F.col("lang") == "en", "ai").when(F.col("lang") == "fr", "chat").otherwise("human")
    return _scored(spark, d).withColumn("corpus", names)


def quantiles(spark, d):
    return corpus.distribution(_corpora(spark, d))


def threshold_sweep(spark, d):
    labels = files.table(spark, d, "labels").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    docs = _scored(spark, d).select("doc_id", "score").join(labels, F.col("doc_id") == F.col("id"))
    return corpus.sweep(docs, F.col("quality") == 1, F.col("quality") == 0, SWEPT)


def category_density(spark, d):
    return corpus.per_category(_corpora(spark, d)).select("corpus", "category", "hits", "with_hit", "doc_pct", "per1k")


def category_lift(spark, d):
    return corpus.lift(_corpora(spark, d)).select("category", "ai_doc_pct", "chat_doc_pct", "human_doc_pct", "ai_per1k", "human_per1k", "lift")


def _extremes(rows):
    said = F.array_join(F.transform("categories", lambda c: F.concat_ws(":", c["category"], c["count"], c["example"])), "|")
    return rows.select("doc_id", "score", "word_count", said.alias("categories"))


def top_false_positives(spark, d):
    return _extremes(corpus.extremes(_corpora(spark, d).where("corpus = 'human'"), 5, True))


def bottom_misses(spark, d):
    return _extremes(corpus.extremes(_corpora(spark, d).where("corpus = 'ai'"), 5, False))


def typography(spark, d):
    docs = scoring.scored(planted.before(spark, d, planted.TYPOGRAPHY)).withColumn("corpus", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    return corpus.typography(docs).withColumn("mean_cv", F.round("mean_cv", 2))


def _paths(spark, d):
    return files.table(spark, d, "pages").select("page_id", F.concat(F.lit("site/"), F.pmod("page_id", F.lit(7)), F.lit("/p"), F.col("page_id"), planted.pick([".html", ".md", ".min.js"], F.col("page_id"))).alias("path"))


def glob_match(spark, d):
    return _paths(spark, d).select("page_id", *(files.matches(F.col("path"), g).alias(k) for k, g in GLOBS.items()))


def clean_wikitext(spark, d):
    docs = planted.before(spark, d, planted.WIKITEXT).withColumn("m", wikitext.clean(F.col("text"), "human"))
    return docs.select("doc_id", _sha(F.col("m")).alias("sha"), F.length("m").alias("chars"))


def _requests(spark, d):
    docs = planted.documents(spark, d)
    n = F.pmod("doc_id", F.lit(8))
    good = F.to_json(F.struct(F.col("text").alias("text")))
    body = F.when(n == 1, "{not json").when(n == 2, "[1]").when(n == 3, '{"txt": 1}').when(n == 4, '{"text": "  "}').when(n == 5, '{"text": "a", "threshold": 101}').when(n == 6, '{"text": "a", "rules": {"nope": "warn"}}').otherwise(good)
    return docs.select(F.col("doc_id").alias("request_id"), F.when(F.pmod("doc_id", F.lit(11)) == 0, "PUT").otherwise("post").alias("method"), F.when(F.pmod("doc_id", F.lit(13)) == 0, "//v1//nothing/").otherwise("/v1//score/").alias("path"), body.alias("body"))


def api_codes(spark, d):
    return api.validated(_requests(spark, d)).select("request_id", "code", api.status(F.col("code"), F.col("verb")).alias("status"))


def api_score(spark, d):
    rows = api.responses(_requests(spark, d)).where("status = 200")
    return rows.select("request_id", F.get_json_object("response", "$.score").cast("int").alias("score"), F.get_json_object("response", "$.band").alias("band"), F.get_json_object("response", "$.wordCount").cast("int").alias("words"))


def api_score_all(spark, d):
    """One valid request for each document; one that the API refuses has a null score."""
    docs = planted.documents(spark, d)
    rows = api.responses(docs.select(F.col("doc_id").alias("request_id"), F.lit("POST").alias("method"), F.lit("/v1/score").alias("path"), F.to_json(F.struct(F.col("text").alias("text"))).alias("body")))
    return rows.select("request_id", "status", F.get_json_object("response", "$.score").cast("int").alias("score"), F.get_json_object("response", "$.band").alias("band"), F.get_json_object("response", "$.wordCount").cast("int").alias("words"))


def _log(spark, d):
    return files.table(spark, d, "events").select(F.col("user_id").cast("string").alias("ip"), F.col("ts").cast("timestamp").alias("ts"))


def rate_limit(spark, d):
    """Every event at its own time, three in any day for each address."""
    rows = api.rate_limited(_log(spark, d), 3, 86_400)
    return rows.groupBy("ip").agg(F.count("*").alias("requests"), F.count_if("admitted").alias("admitted"), F.max(F.when(~F.col("admitted"), F.unix_micros("ts"))).alias("last_refused"))


def rate_limit_default(spark, d):
    """The default limit of 120 in 60 seconds, all events as of one address a kind."""
    rows = api.rate_limited(files.table(spark, d, "events").select(F.col("event_type").alias("ip"), F.col("ts").cast("timestamp").alias("ts")))
    return rows.groupBy("ip").agg(F.count("*").alias("requests"), F.count_if("admitted").alias("admitted"))


def api_get(spark, d):
    """The bodies of the routes without a request text."""
    rows = spark.createDataFrame([(i, "GET", p) for i, p in enumerate(("/", "/health", "//v1/health/", "/v1/rules", "/openapi.json", "/nothing"))], "request_id long, method string, path string").withColumn("body", F.lit(None).cast("string"))
    out = api.responses(rows)
    got = {k: F.get_json_object("response", f"$.{k}") for k in ("status", "categories", "patterns")}
    size = F.json_array_length(F.get_json_object("response", "$.rules"))
    return out.select("request_id", F.col("status").alias("code"), got["status"].alias("status"), got["categories"].cast("int").alias("categories"), got["patterns"].cast("int").alias("patterns"), size.alias("rules"))


def _reported(spark, d):
    return _linted(spark, d, threshold=25).withColumn("path", F.concat(F.lit("docs/a:"), F.col("doc_id"), F.lit(".md")))


def report_github(spark, d):
    return sinks.github_lines(_reported(spark, d)).select("path", "value")


def report_json(spark, d):
    rows = sinks.json_lines(_reported(spark, d))

    def at(path, kind="int"):
        return F.get_json_object("value", f"$.{path}").cast(kind)

    first = [at("findings[0].ruleId", "string").alias("rule"), at("findings[0].line").alias("line"), at("findings[0].message", "string").alias("message")]
    size = F.json_array_length(F.get_json_object("value", "$.findings"))
    return rows.select("path", at("score").alias("score"), at("band", "string").alias("band"), at("wordCount").alias("words"), at("errorCount").alias("errors"), at("warningCount").alias("warnings"), at("thresholdExceeded", "boolean").alias("over"), size.alias("findings"), *first)


def report_sarif(spark, d):
    rows = sinks.sarif_results(_reported(spark, d))

    def at(path, kind="string"):
        return F.get_json_object("value", f"$.{path}").cast(kind)

    region = "locations[0].physicalLocation.region"
    return rows.select(
        at("locations[0].physicalLocation.artifactLocation.uri").alias("path"), at("ruleId").alias("category"), at("level").alias("level"), at("message.text").alias("message"), at(f"{region}.startLine", "int").alias("line"),
        at(f"{region}.startColumn", "int").alias("column"), at(f"{region}.endColumn", "int").alias("endColumn"), at(f"{region}.snippet.text").alias("match"), at("properties.tier").alias("tier"), at("properties.pattern").alias("pattern"), at("properties.documentScore", "int").alias("score"),
    )


def report_pretty(spark, d):
    return sinks.pretty_blocks(_reported(spark, d)).select("path", F.size(F.split("value", "\n")).alias("lines"))


def stream_score(spark, d):
    """The documents' folder as a stream, scored to its end."""
    name = "documents.parquet"
    schema = files.table(spark, d, "documents").schema
    place = stream.new_folder(spark)
    single = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}")
    plain = not single.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(single).isDirectory()
    docs = stream.documents(spark, d if plain else f"{d}/{name}", schema, name if plain else "*.parquet")
    docs = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), planted.pick(planted.EXAMPLES, F.col("doc_id")), F.lit("\n")))
    stream.run_to_end(stream.scores(docs), f"{place}/out", f"{place}/state")
    return spark.read.schema("doc_id long, word_count int, score int, band string").parquet(f"{place}/out")


QUERIES: dict[str, Query] = {
    "word_count": word_count, "normalize": normalize,
    "mask_code": _masked(planted.STRUCTURE, text.mask_code), "mask_front_matter": _masked(planted.STRUCTURE, extraction.mask_front_matter),
    "mask_urls": _masked(planted.STRUCTURE, extraction.mask_urls), "mask_html": mask_html, "mask_tables": _masked(planted.STRUCTURE, extraction.mask_tables),
    "extract_comments": _masked(planted.STRUCTURE, extraction.extract_comments), "extract_prose": extract_prose, "is_lintable": is_lintable,
    "em_dash": _metric("emDash", ["total", "spaced", "perThousand", "spacedShare", "flag"]), "quotes": _metric("quotes", ["curly", "straight", "mixed", "flag"]),
    "burstiness": _metric("burstiness", ["sentences", "meanLength", "cv", "flag", "note"]), "paragraphs": _metric("paragraphs", ["paragraphs", "meanLength", "cv", "flag"]),
    **{f"hits_{c.id}": _hits(c.id) for c in CATEGORIES},
    "match_category": match_category, "category_points": category_points, "score": score, "score_only": score_only, "band": band, "top_hits": top_hits, "reports": reports,
    "severity_resolve": severity_resolve, "positions": positions, "findings": findings, "max_hits": max_hits, "lint_counts": lint_counts, "summarize": summarize, "over_threshold": over_threshold, "quiet": quiet,
    "rules_list": rules_list, "pattern_index": pattern_index, "health": health, "self_test": self_test,
    "quantiles": quantiles, "threshold_sweep": threshold_sweep, "category_density": category_density, "category_lift": category_lift,
    "top_false_positives": top_false_positives, "bottom_misses": bottom_misses, "typography": typography,
    "glob_match": glob_match, "clean_wikitext": clean_wikitext, "api_codes": api_codes, "api_score": api_score, "api_score_all": api_score_all, "rate_limit": rate_limit, "rate_limit_default": rate_limit_default, "api_get": api_get,
    "report_json": report_json, "report_github": report_github, "report_sarif": report_sarif, "report_pretty": report_pretty, "stream_score": stream_score,
}
