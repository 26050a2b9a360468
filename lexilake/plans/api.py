"""Batches of requests as a DataFrame: (request_id, method, path, body) to (request_id, status, code,
response). Serving them over a network is no part of the engine. Error rows never hold request text."""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPACE
from ..functions.text import utf16_length
from ..operators import extraction, linting
from ..operators.catalogue import CATEGORIES, TIER_SEVERITY
from ..sources.sinks import DISCLAIMER, FINDING_FIELDS, TOOL, VERSION

#: Limits and routes.
MAX_BODY_BYTES = 512 * 1024
MAX_TEXT_UNITS = 200_000
GET_ROUTES = ("/", "/health", "/v1/health", "/v1/rules", "/openapi.json")
POST_ROUTES = ("/v1/lint", "/v1/score")
STATUS = {"not_found": 404, "method_not_allowed": 405, "body_too_large": 413, "text_too_large": 413}
SEVERITIES = ('"off"', '"warn"', '"warning"', '"error"', '"0"', '"1"', '"2"', "0", "1", "2", "true", "false")


def normal_path(path: Column) -> Column:
    p = F.regexp_replace(path, "/{2,}", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def field(body: Column, name: str) -> Column:
    """A field of a JSON object as JSON text: parsed as a variant, so its type can be told."""
    return F.to_json(F.try_variant_get(body, f"$.{name}", "variant"))


def validated(requests: DataFrame) -> DataFrame:
    """Adds route, code (null: fine) and the request's fields. The order of the checks is the API's:
    route, size, JSON, object, text, limits, severities before unknown rules."""
    out = requests.withColumn("route", normal_path(F.coalesce("path", F.lit("/")))).withColumn("verb", F.upper(F.coalesce("method", F.lit("GET"))))
    out = out.withColumn("raw_body", F.when(F.coalesce("body", F.lit("")) == "", "{}").otherwise(F.col("body")))
    fits = F.octet_length("raw_body") <= MAX_BODY_BYTES
    out = out.withColumn("json", F.when(fits, F.try_parse_json("raw_body")))
    for name in ("text", "rules", "threshold", "maxHitsPerRule", "filePath", "extract"):
        out = out.withColumn(f"j_{name}", field(F.col("json"), name))
    out = out.withColumn("text", F.when(F.col("j_text").startswith('"'), F.try_variant_get("json", "$.text", "string")))
    out = out.withColumn("rules", F.try_variant_get("json", "$.rules", "map<string,variant>"))
    out = out.withColumn("rules", F.transform_values("rules", lambda _, v: F.to_json(v)))
    number = r"^-?[0-9]"

    def bad_number(j: str, most: float | None) -> Column:
        v = F.col(j).try_cast("double")
        wrong = ~F.col(j).rlike(number) | (v < 0)
        return F.col(j).isNotNull() & (F.col(j) != "null") & (wrong if most is None else wrong | (v > most))

    values = F.map_values("rules")
    known = F.array(*(F.lit(c.id) for c in CATEGORIES))
    allowed = F.array(*map(F.lit, SEVERITIES))
    at_known = F.filter(F.map_entries("rules"), lambda e: F.array_contains(known, e["key"]) & (e["value"] != "null"))
    code = (
        F.when(F.col("verb") == "OPTIONS", None)
        .when(F.col("verb") == "GET", F.when(~F.col("route").isin(*GET_ROUTES), "not_found"))
        .when(F.col("verb") != "POST", "method_not_allowed")
        .when(~F.col("route").isin(*POST_ROUTES), "not_found")
        .when(~fits, "body_too_large")
        .when(F.col("json").isNull(), "invalid_json")
        .when(~F.ltrim("raw_body").startswith("{"), "invalid_body")
        .when(F.col("text").isNull(), "missing_text")
        .when(F.regexp_replace("text", f"[{SPACE}]+", "") == "", "empty_text")
        .when(utf16_length(F.col("text")) > MAX_TEXT_UNITS, "text_too_large")
        .when(bad_number("j_threshold", 100), "invalid_threshold")
        .when(bad_number("j_maxHitsPerRule", None), "invalid_max_hits")
        .when(F.exists(at_known, lambda e: ~F.array_contains(allowed, e["value"])), "invalid_rules")
        .when(F.exists(F.map_keys("rules"), lambda k: ~F.array_contains(known, k)), "unknown_rule")
    )
    out = out.withColumn("code", code).withColumn("threshold", F.col("j_threshold").try_cast("double")).withColumn("max_hits", F.coalesce(F.col("j_maxHitsPerRule").try_cast("double").cast("int"), F.lit(0)))
    name = F.when(F.col("j_filePath").startswith('"') & (F.col("j_filePath") != '""'), F.try_variant_get("json", "$.filePath", "string")).otherwise("input")
    out = out.withColumn("file", name).withColumn("rules", F.transform_values("rules", lambda _, v: F.regexp_replace(v, '^"|"$', "")))
    return out.withColumn("extract", F.coalesce(F.col("j_extract") == "true", F.lit(False))).drop("json", "raw_body", *(f"j_{n}" for n in ("text", "rules", "threshold", "maxHitsPerRule", "filePath", "extract")))


def status(code: Column, verb: Column) -> Column:
    out = F.when(code.isNull() & (verb == "OPTIONS"), 204).when(code.isNull(), 200)
    for name, n in STATUS.items():
        out = out.when(code == name, n)
    return out.otherwise(400)


def responses(requests: DataFrame) -> DataFrame:
    """Requests answered: request_id, status, code, response (JSON; null for errors and for OPTIONS)."""
    checked = validated(requests)
    ok = checked.where(F.col("code").isNull() & (F.col("verb") == "POST"))
    prose = F.when(F.col("extract"), extraction.extract_prose(F.col("text"), F.col("file"))["text"]).otherwise(F.col("text"))
    linted = linting.lint(ok.select("request_id", "route", "file", "rules", "threshold", "max_hits", prose.alias("text")), rules=F.col("rules"), threshold=F.col("threshold"), max_hits_per_rule=F.col("max_hits"))
    findings = F.transform("findings", lambda f: F.struct(*(f[k].alias(k) for k in FINDING_FIELDS)))
    one = F.struct(F.col("file").alias("filePath"), "score", "band", F.col("word_count").alias("wordCount"), "errorCount", "warningCount", "thresholdExceeded", "metrics", findings.alias("findings"))
    over = F.when(F.col("thresholdExceeded"), F.array(F.struct(F.col("file").alias("filePath"), F.col("score").alias("score")))).otherwise(F.array().cast("array<struct<filePath: string, score: int>>"))
    summary = F.struct(F.lit(1).alias("files"), F.col("errorCount").alias("errors"), F.col("warningCount").alias("warnings"), over.alias("overThreshold"), ((F.col("errorCount") > 0) | F.col("thresholdExceeded")).alias("failed"))
    options = {"ignoreNullFields": "false"}
    lint_body = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(DISCLAIMER).alias("disclaimer"), summary.alias("summary"), F.array(one).alias("results")), options)
    score_body = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(DISCLAIMER).alias("disclaimer"), "score", "band", F.col("word_count").alias("wordCount"), "thresholdExceeded", "metrics"), options)
    good = linted.select("request_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("code"), F.when(F.col("route") == "/v1/lint", lint_body).otherwise(score_body).alias("response"))
    body = F.lit(None).cast("string")
    for route, text in get_bodies().items():
        body = F.when((F.col("verb") == "GET") & (F.col("route") == route), F.lit(text)).otherwise(body)
    rest = checked.where(F.col("code").isNotNull() | (F.col("verb") != "POST"))
    return good.unionByName(rest.select("request_id", status(F.col("code"), F.col("verb")).alias("status"), "code", body.alias("response")))


def rate_limited(log: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """Marks entries (ip, ts) of an access log that a sliding log of ``seconds`` would refuse. Only
    admitted entries count against the limit, so each address is walked in order of time; the state is
    at most ``limit`` timestamps. A null address is one of its own; a limit of 0 admits all."""
    span = seconds * 1_000_000

    def walk(batches):
        now, held = object(), deque()
        for b in batches:
            flags = []
            for ip, ts in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if ip != now:
                    now, held = ip, deque()
                while held and ts is not None and held[0] <= ts - span:
                    held.popleft()
                good = not limit or ts is None or len(held) < limit
                if good and ts is not None:
                    held.append(ts)
                flags.append(good)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(flags, pa.bool_())], ["ip", "ts", "admitted"])

    rows = log.select("ip", "ts").repartition("ip").sortWithinPartitions("ip", "ts")
    return rows.select("ip", "ts", F.unix_micros("ts")).mapInArrow(walk, "ip string, ts timestamp, admitted boolean")


def get_bodies() -> dict[str, str]:
    """The JSON bodies of the routes without a request, made from the catalogue."""
    ids = [c.id for c in CATEGORIES]
    counts = {"status": "ok", "version": VERSION, "categories": len(CATEGORIES), "patterns": sum(len(c.patterns) for c in CATEGORIES)}
    listed = [{"id": c.id, "label": c.label, "tier": c.tier, "defaultSeverity": TIER_SEVERITY[c.tier], "patterns": [p.id for p in c.patterns]} for c in CATEGORIES]
    severity = {"type": "string", "enum": ["off", "warn", "error"]}
    share = {"type": "number", "minimum": 0, "maximum": 100}
    request = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "maxLength": MAX_TEXT_UNITS}, "rules": {"type": "object", "propertyNames": {"enum": ids}, "additionalProperties": severity}, "threshold": share, "filePath": {"type": "string"}, "maxHitsPerRule": {"type": "integer", "minimum": 0}, "extract": {"type": "boolean", "default": False}}}
    error = {"type": "object", "properties": {"error": {"type": "object", "properties": {"code": {"type": "string"}, "message": {"type": "string"}}}}}

    def answer(what: str, schema: dict | None = None) -> dict:
        return {"description": what, "content": {"application/json": {"schema": schema or {"type": "object"}}}}

    def post(what: str) -> dict:
        return {"post": {"summary": what, "requestBody": {"required": True, "content": {"application/json": {"schema": request}}}, "responses": {"200": answer("result"), "400": answer("bad request", error), "413": answer("too large", error)}}}

    paths = {r: {"get": {"summary": w, "responses": {"200": answer(w)}}} for r, w in (("/health", "state and size of the catalogue"), ("/v1/rules", "the rules"))}
    paths |= {"/v1/lint": post("positioned findings and the score"), "/v1/score": post("the score alone")}
    index = {"name": TOOL, "version": VERSION, "disclaimer": DISCLAIMER, "routes": [f"GET {r}" for r in GET_ROUTES] + [f"POST {r}" for r in POST_ROUTES]}
    openapi = {"openapi": "3.1.0", "info": {"title": TOOL, "version": VERSION, "description": DISCLAIMER}, "paths": paths}
    bodies = {"/": index, "/health": counts, "/v1/health": counts, "/v1/rules": {"version": 1, "rules": listed}, "/openapi.json": openapi}
    return {k: json.dumps(v, ensure_ascii=False) for k, v in bodies.items()}
