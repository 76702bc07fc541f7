"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.functions.checks import email_shape_sql, luhn_sql, severity_sql
from textwarden.functions.spans import Prepared, match_spans, matches_sql
from textwarden.operators import entities as ent
from textwarden.operators import policy, resolve, scan, summary
from textwarden.operators.redact import redact
from textwarden.plans import inputs
from textwarden.rules import (ENTITY_TYPES_ADVANCED, ENTITY_TYPES_APP, ENTITY_TYPES_PRESIDIO,
                              HIGH, PATTERNS, PROFILES, Pattern, Rule)
from textwarden.sources import audit, lines, requests, responses
from textwarden.sources.messages import concat_messages
from textwarden.sources.tables import bucketed, fresh_path, read_table, spread
from textwarden.streaming import monitor, stateful

QUERIES = {}


def query(name: str, **fixed):
    """Register a query; ``fixed`` arguments allow one function per family."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, sf_dir, **fixed)
        return fn
    return register


FINDING_COLUMNS = ["rule_ord", "type", "confidence", "start_pos", "end_pos", "severity",
                   "context", "detector", "entity_text"]


def conversation_texts(spark, sf_dir, separator=" ") -> DataFrame:
    return concat_messages(inputs.chats(spark, sf_dir), separator)


def scanned(spark, sf_dir, profile, with_context=False) -> DataFrame:
    return scan.scan(inputs.texts(spark, sf_dir), profile, with_context)


def resolved(spark, sf_dir, profile, with_context=False) -> DataFrame:
    return resolve.resolve(scanned(spark, sf_dir, profile, with_context),
                           PROFILES[profile].rank)


# ---- requests, messages, responses, logs --------------------------------------------------

@query("parse_requests")
def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse_requests(inputs.requests(spark, sf_dir)).select(
        "request_id", "status", "error")


@query("validate_requests")
def validate_requests(spark, sf_dir):
    parsed = requests.parse_requests(inputs.requests(spark, sf_dir))
    return requests.validate(parsed).select(
        "request_id", "model", "n_messages", "temperature", "max_tokens", "top_p", "stream",
        F.array_join("reject_reason", ",").alias("reject_reason"))


@query("reject_empty")
def reject_empty(spark, sf_dir):
    parsed = requests.parse_requests(inputs.requests(spark, sf_dir))
    return requests.reject_empty(parsed).select("request_id", "status", "error")


@query("concat_messages_space", separator=" ")
@query("concat_messages_newline", separator="\n")
def concatenated(spark, sf_dir, separator):
    return conversation_texts(spark, sf_dir, separator).select("conv_id", "n_messages", "text")


@query("flatten_multimodal")
def flatten_multimodal(spark, sf_dir):
    parsed = requests.parse_requests(inputs.requests(spark, sf_dir))
    return requests.request_texts(requests.valid_requests(parsed), multimodal=True).select(
        "request_id", "text")


@query("error_rows")
def error_rows(spark, sf_dir):
    parsed = requests.parse_requests(inputs.requests(spark, sf_dir))
    return requests.request_texts(parsed).select(
        "request_id", "status", "error", F.length("text").cast("long").alias("n_chars"))


@query("normalize_responses")
def normalize_responses(spark, sf_dir):
    return responses.normalize_responses(inputs.responses(spark, sf_dir)).select(
        "request_id", "status", "error", "id", "object", "created", "model",
        F.size("choices").cast("long").alias("n_choices"),
        F.get("choices.index", F.lit(0)).alias("choice_index"),
        F.get("choices.message.role", F.lit(0)).alias("role"),
        F.get("choices.message.content", F.lit(0)).alias("content"),
        F.get("choices.finish_reason", F.lit(0)).alias("finish_reason"),
        "usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens")


@query("sse_lines")
def sse_lines(spark, sf_dir):
    return responses.sse_lines(inputs.stream_lines(spark, sf_dir))


ENRICHED = ["request_id", "id", "security_scan.issues_detected", "security_scan.risk_level",
            "security_scan.gateway_version", "security_scan.scan_summary.issue_types", "stream_prefix"]


def request_scans(requests_df: DataFrame, *times: str) -> DataFrame:
    """What the scan of each served request found; a narrow pass, batch or stream."""
    parsed = requests.parse_requests(requests_df)
    served = monitor.timed_filter(parsed, "status = 200", *times) if times else requests.valid_requests(parsed)
    texts = requests.request_texts(served, multimodal=True).select("request_id", *times, "text")
    return summary.summarise(resolve.resolve(scan.scan(texts, "presidio"), rank=True),
                             "presidio", "request_id", *times)


@query("enrich_responses")
def enrich_responses(spark, sf_dir):
    served = responses.normalize_responses(inputs.responses(spark, sf_dir)).where("status = 200")
    return responses.enrich_responses(
        served, request_scans(inputs.requests(spark, sf_dir))).select(*ENRICHED)


@query("request_log")
def request_log(spark, sf_dir):
    found = resolve.resolve(scan.scan(conversation_texts(spark, sf_dir), "enhanced"))
    return audit.request_log(found, "conv_id", "n_messages").withColumn(
        "issue_lines", F.array_join("issue_lines", "; "))


@query("audit_records")
def audit_records(spark, sf_dir):
    events = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    monitor.use_utc(spark)
    records = audit.audit_records(events, "ts", "event_id", "user_id", "event_type", "value")
    return records.select(
        F.col("date").cast("string").alias("date"),
        F.get_json_object("record", "$.timestamp").alias("timestamp"),
        F.get_json_object("record", "$.event_id").cast("long").alias("event_id"),
        F.get_json_object("record", "$.event_type").alias("event_type"))


@query("audit_trail")
def audit_trail(spark, sf_dir):
    """The audit records of all events through the sink, in two batches; one of them comes twice, and
    before it a write that never got to its commit."""
    monitor.use_utc(spark)
    events = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    path = fresh_path(spark, "audit")

    def records(odd: int) -> DataFrame:
        return audit.audit_records(events.where(f"event_id % 2 = {odd}"), "ts", "event_id", "event_type")

    records(0).write.partitionBy("date").parquet(f"{path}/records/batch=even/attempt=lost")
    for odd, batch in ((0, "even"), (1, "odd"), (0, "even")):
        audit.append_audit(records(odd), path, batch)
    return audit.read_audit(spark, path).select(
        "batch", F.col("date").cast("string").alias("date"),
        F.get_json_object("record", "$.timestamp").alias("timestamp"),
        F.get_json_object("record", "$.event_id").cast("long").alias("event_id"))


@query("request_lines")
def request_lines(spark, sf_dir):
    """Requests through a folder of JSON lines, some of them broken: the good ones, and how many lines
    were set aside at a place of their own."""
    path = fresh_path(spark, "lines")
    named = F.when(F.col("kind") == 0, F.col("body")).otherwise(
        F.concat(F.lit('{"request_id": "'), "request_id", F.lit('", '), F.expr("substring(body, 2)")))
    inputs.requests(spark, sf_dir).select(named).write.text(path)
    parsed = lines.parse_lines(lines.lines(spark, path), "request_id string, model string, messages array<variant>")
    good = lines.good_lines(parsed).select("request_id", "model", F.size("messages").cast("long").alias("n"))
    places = lines.quarantine(parsed).agg(F.count_distinct("file", "line_number").alias("n"))
    return good.unionByName(places.select(F.lit("set aside").alias("request_id"),
                                          F.lit(None).cast("string").alias("model"), "n"))


# ---- detection ----------------------------------------------------------------------------

@query("presence_cloud", profile="cloud")
@query("presence_railway", profile="railway")
@query("presence_minimal", profile="minimal")
def presence(spark, sf_dir, profile):
    return scan.rule_names(inputs.texts(spark, sf_dir), profile, "doc_id").select(
        "doc_id", F.array_join("names", ",").alias("rules"))


@query("spans_presidio", profile="presidio")
@query("spans_enhanced", profile="enhanced")
@query("spans_simple", profile="simple")
@query("spans_advanced", profile="advanced")
@query("spans_recognizers", profile="recognizers")
def spans(spark, sf_dir, profile):
    return scan.explode_findings(scanned(spark, sf_dir, profile), "doc_id").select(
        "doc_id", *FINDING_COLUMNS)


@query("scan_function")
def scan_function(spark, sf_dir):
    """``spans_enhanced`` by the SQL function."""
    scan.register_scan(spark, "enhanced", "findings_of")
    inputs.texts(spark, sf_dir).createOrReplaceTempView("scanned_texts")
    return spark.sql(f"""SELECT doc_id, {", ".join("f." + c for c in FINDING_COLUMNS)}
        FROM (SELECT doc_id, findings_of(text) AS found FROM scanned_texts) LATERAL VIEW OUTER explode(found) v AS f
        WHERE f.type IS NOT NULL""")


@query("least_confidence")
def least_confidence(spark, sf_dir, least: float = 0.8):
    """Findings of a minimum confidence."""
    sure = scan.at_least(scanned(spark, sf_dir, "presidio"), least)
    return scan.explode_findings(sure, "doc_id").select("doc_id", "type", "confidence", "start_pos")


@query("rule_catalogue")
def rule_catalogue(spark, sf_dir):
    """All rule rows of all profiles with the number of texts their pattern is in;
    every distinct pattern is tested once, in one pass."""
    prepared = Prepared(PATTERNS.values())
    counts = prepared.add(inputs.texts(spark, sf_dir)).agg(*[
        F.count_if(F.expr(matches_sql("text", p, prepared))).alias(k) for k, p in PATTERNS.items()])
    counts = counts.select(F.explode(F.create_map(*[
        c for k in PATTERNS for c in (F.lit(k), F.col(k))])).alias("pattern", "n_texts"))
    key_of = {p: k for k, p in PATTERNS.items()}
    rows = [(name, i, r.name, key_of[r.pattern], r.confidence, r.severity)
            for name, prof in PROFILES.items() for i, r in enumerate(prof.rules)]
    catalogue = spark.createDataFrame(
        rows, "profile string, rule_ord int, rule string, pattern string, confidence double, "
              "severity string")
    return F.broadcast(catalogue).join(counts, "pattern")   # a fixed, small table


@query("hits_per_rule")
def hits_per_rule(spark, sf_dir):
    rules = spark.createDataFrame(
        [(r.name, r.severity, r.description) for r in PROFILES["enhanced"].rules],
        "type string, severity string, description string")
    hits = scan.explode_findings(scanned(spark, sf_dir, "enhanced"), "doc_id").groupBy("type").agg(
        F.count("*").alias("hits"))
    # one row per rule at most, so the counts are sent to the catalogue
    return rules.join(F.broadcast(hits), "type", "left").select(
        "type", "severity", "description", F.coalesce("hits", F.lit(0)).alias("hits"))


CUSTOM_RULES = [Rule("custom_token", Pattern(r"ct_[a-zA-Z0-9]{32}"), 0.9, HIGH, "Custom token"),
                Rule("ssn", Pattern(r"never"), 0.1, HIGH, "overridden")]


@query("custom_rule_scan")
def custom_rule_scan(spark, sf_dir):
    profile = PROFILES["advanced"].with_rules(CUSTOM_RULES)
    return scan.explode_findings(scan.scan(inputs.texts(spark, sf_dir), profile), "doc_id").select(
        "doc_id", *FINDING_COLUMNS)


def exploded_spans(texts: DataFrame, pattern: Pattern) -> DataFrame:
    return texts.select("doc_id", F.explode_outer(match_spans("text", pattern)).alias("s")).where(
        "s.hit IS NOT NULL").select(
        "doc_id", F.col("s.start_pos").cast("long").alias("start_pos"),
        F.col("s.end_pos").cast("long").alias("end_pos"), F.col("s.hit").alias("hit"))


@query("cards_luhn")
def cards_luhn(spark, sf_dir):
    return exploded_spans(inputs.texts(spark, sf_dir), PATTERNS["card_grouped"]).withColumn(
        "valid", F.expr(luhn_sql("hit")))


@query("email_shape")
def email_shape(spark, sf_dir):
    candidates = Pattern(r"[^ \n]*@[^ \n]*", needs=(("@",),))
    return exploded_spans(inputs.texts(spark, sf_dir), candidates).withColumn(
        "valid", F.expr(email_shape_sql("hit")))


@query("udf_validator")
def udf_validator(spark, sf_dir):
    """A user validator for what SQL cannot say, applied to the few candidate
    matches after extraction (Arrow batches), never to whole texts."""
    @F.pandas_udf("boolean")
    def area_code_ok(numbers: pd.Series) -> pd.Series:
        digits = numbers.str.replace(r"[^0-9]", "", regex=True).str[-10:]
        return ~digits.str[:1].isin(["0", "1"])

    return exploded_spans(inputs.texts(spark, sf_dir), PATTERNS["phone"]).withColumn(
        "valid", area_code_ok("hit"))


@query("finding_context")
def finding_context(spark, sf_dir):
    return scan.explode_findings(scanned(spark, sf_dir, "simple"), "doc_id").select(
        "doc_id", "type", "start_pos", "context")


@query("context_decay")
def context_decay(spark, sf_dir):
    return scan.explode_findings(scanned(spark, sf_dir, "advanced"), "doc_id").where(
        "type = 'aws_secret_key'").select("doc_id", "start_pos", "confidence")


@query("exfiltration")
def exfiltration(spark, sf_dir):
    found = inputs.texts(spark, sf_dir).withColumn(
        "findings", F.expr(scan.exfiltration_sql("text")))
    return scan.explode_findings(found, "doc_id").select(
        "doc_id", "type", "confidence", F.col("end_pos").cast("long").alias("end_pos"), "severity",
        "context", "detector")


@query("heuristic_scan")
def heuristic_scan(spark, sf_dir):
    return policy.decide_names(scan.mentions(conversation_texts(spark, sf_dir), "conv_id"), "minimal"
                               ).select("conv_id", F.array_join("issues", ",").alias("issues"),
                                        "blocked")


# ---- external entities --------------------------------------------------------------------

@query("entity_postfilter")
def entity_postfilter(spark, sf_dir):
    texts = inputs.texts(spark, sf_dir)
    return ent.entity_findings(inputs.entities(texts), texts).select(
        "doc_id", "type", "description", "confidence", "start_pos", "end_pos", "severity",
        "context", "detector", "entity_text")


@query("dev_context")
def dev_context(spark, sf_dir):
    return inputs.texts(spark, sf_dir).select(
        "doc_id", F.expr(ent.is_development_text("text")).alias("dev"))


@query("entity_types")
def entity_types(spark, sf_dir):
    found = inputs.entities(inputs.texts(spark, sf_dir))
    return found.groupBy("entity_type").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("entity_type").isin(list(types))).alias(name) for name, types in (
            ("app", ENTITY_TYPES_APP), ("advanced", ENTITY_TYPES_ADVANCED),
            ("presidio", ENTITY_TYPES_PRESIDIO))])


@query("entity_labels")
def entity_labels(spark, sf_dir):
    found = inputs.entities(inputs.texts(spark, sf_dir))
    return ent.entity_labels(found, ENTITY_TYPES_APP, "PII detected: ")


@query("toggle_matrix")
def toggle_matrix(spark, sf_dir):
    """Issues and blocked texts for every setting of the two detector switches."""
    texts = inputs.texts(spark, sf_dir)
    pii = ent.entity_labels(inputs.entities(texts), ENTITY_TYPES_APP).groupBy("doc_id").agg(
        F.count("*").alias("pii"))
    secrets = scan.rule_names(texts, "minimal", "doc_id").select(
        "doc_id", F.size("names").alias("secrets"))
    both = secrets.join(pii, "doc_id", "left").select(
        "secrets", F.coalesce("pii", F.lit(0)).alias("pii"))
    settings = [(p, s) for p in (True, False) for s in (True, False)]
    totals = both.agg(*[
        F.struct(F.lit(p).alias("pii_on"), F.lit(s).alias("secrets_on"), F.sum(n).alias("issues"),
                 F.count_if(n > 0).alias("blocked")).alias(f"{p}_{s}")
        for p, s in settings for n in [F.col("pii") * int(p) + F.col("secrets") * int(s)]])
    return totals.select(F.explode(F.array(*[f"{p}_{s}" for p, s in settings])).alias("x")).select("x.*")


@query("app_decisions")
def app_decisions(spark, sf_dir):
    """Decision rows of both detectors, entity labels first."""
    texts = inputs.texts(spark, sf_dir)
    return ent.app_decisions(inputs.entities(texts), texts).withColumn(
        "issues", F.array_join("issues", ","))


@query("block_rate")
def block_rate(spark, sf_dir):
    texts = spread(read_table(spark, sf_dir, "documents", "lang", "text"))
    return summary.block_rate(
        policy.decide_names(scan.rule_names(texts, "minimal", "lang"), "minimal"), "lang")


@query("merged_findings")
def merged_findings(spark, sf_dir):
    texts = inputs.texts(spark, sf_dir)
    return ent.merged_findings(inputs.entities(texts), texts).select(
        "doc_id", "type", "confidence", "start_pos", "end_pos", "severity", "detector")


# ---- joins --------------------------------------------------------------------------------

@query("clean_texts", clean=True)
@query("flagged_texts", clean=False)
def by_findings(spark, sf_dir, clean):
    """Texts without (with) findings. Findings sit in the row of their text, so
    this needs no join; ``summary.texts_without`` joins against a stored table."""
    return scan.split_texts(scanned(spark, sf_dir, "presidio"), clean, "doc_id",
                            F.length("text").cast("long").alias("n_chars"))


@query("clean_texts_joined", clean=True)
@query("flagged_texts_joined", clean=False)
def by_stored_findings(spark, sf_dir, clean):
    """Texts without (with) rows in a stored table of findings. Both tables are stored in buckets of the
    key, so the join moves neither."""
    sizes = inputs.texts(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"))
    found = scan.explode_findings(scanned(spark, sf_dir, "presidio"), "doc_id").select("doc_id", "type", "start_pos")
    choose = summary.texts_without if clean else summary.texts_with
    return choose(bucketed(sizes, "sizes", "doc_id"), bucketed(found, "findings", "doc_id"))


# ---- resolution, ranking, policy ----------------------------------------------------------

@query("dedupe_presidio", profile="presidio")
@query("dedupe_enhanced", profile="enhanced")
@query("dedupe_advanced", profile="advanced", with_context=True)
def dedupe(spark, sf_dir, profile, with_context=False):
    return scan.explode_findings(resolved(spark, sf_dir, profile, with_context), "doc_id").select(
        "doc_id", "type", "confidence", "start_pos", "end_pos", "severity", "detector")


@query("confidence_severity")
def confidence_severity(spark, sf_dir):
    found = inputs.entities(inputs.texts(spark, sf_dir))
    return found.groupBy("score").agg(F.count("*").alias("n")).withColumn(
        "severity", F.expr(severity_sql("score")))


@query("ranked_findings")
def ranked_findings(spark, sf_dir, top: int = 3):
    """The best findings of each text."""
    best = resolved(spark, sf_dir, "presidio")
    return best.select("doc_id", F.posexplode_outer("findings").alias("pos", "f")).where(
        f"pos < {top}").select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("rnk"), "f.type", "f.confidence",
        "f.start_pos")


@query("policy_any", profile="minimal")
@query("policy_flag", profile="cloud")
def policy_names(spark, sf_dir, profile):
    texts = conversation_texts(spark, sf_dir, PROFILES[profile].separator)
    return scan.flag_texts(texts, profile, "conv_id")


@query("policy_high80", profile="enhanced")
@query("policy_threshold", profile="advanced")
@query("policy_high95", profile="presidio")
def policy_findings(spark, sf_dir, profile):
    return policy.decide_findings(resolved(spark, sf_dir, profile), profile, "doc_id").select(
        "doc_id", "blocked", "total_issues")


@query("decisions")
def decisions(spark, sf_dir):
    """Decision rows of a name profile over the documents."""
    names = scan.rule_names(inputs.texts(spark, sf_dir), "railway", "doc_id")
    rows = policy.decide_names(names, "railway", prefix="Detected: ")
    return rows.withColumn("issues", F.array_join("issues", ","))


SUMMARY_COLUMNS = ["clean", "total_issues", "critical", "high", "medium", "low", "issue_types",
                   "max_confidence", "should_block"]


@query("summary_presidio", profile="presidio")
@query("summary_advanced", profile="advanced")
def document_summary(spark, sf_dir, profile):
    extra = ["from_entities", "from_rules"] if profile == "presidio" else []
    return summary.summarise(resolved(spark, sf_dir, profile), profile, "doc_id").select(
        "doc_id", *SUMMARY_COLUMNS, *extra)


@query("summary_enhanced", profile="enhanced")
@query("summary_simple", profile="simple")
def conversation_summary(spark, sf_dir, profile):
    found = scan.scan(conversation_texts(spark, sf_dir), profile)
    if PROFILES[profile].dedupe:
        found = resolve.resolve(found)
    return summary.summarise(found, profile, "conv_id").select("conv_id", *SUMMARY_COLUMNS)


@query("issue_payload")
def issue_payload(spark, sf_dir):
    found = scan.explode_findings(resolved(spark, sf_dir, "presidio"), "doc_id")
    return summary.issue_payload(found, "presidio", "doc_id", "start_pos")


@query("redact")
def redacted(spark, sf_dir):
    return redact(resolved(spark, sf_dir, "enhanced")).select("doc_id", "redacted")


# ---- aggregations -------------------------------------------------------------------------

@query("scan_stats")
def scan_stats(spark, sf_dir):
    return summary.scan_counters(
        summary.summarise(resolved(spark, sf_dir, "presidio"), "presidio", "doc_id"))


@query("observed_stats")
def observed_stats(spark, sf_dir):
    """``scan_stats``, counted while the summaries are stored."""
    rows = summary.summarise(resolved(spark, sf_dir, "presidio"), "presidio", "doc_id")
    return summary.store_and_count(rows, "summaries")[1]


@query("severity_breakdown")
def severity_breakdown(spark, sf_dir):
    found = scan.explode_findings(resolved(spark, sf_dir, "enhanced"), "doc_id")
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s.lower())
                       for s in summary.SEVERITIES])


@query("detector_breakdown")
def detector_breakdown(spark, sf_dir):
    texts = inputs.texts(spark, sf_dir)
    rows = ent.merged(inputs.entities(texts), texts)
    return rows.agg(*[F.expr(f"coalesce(sum(size(filter(findings, f -> f.detector = '{d}'))), 0)").alias(d)
                      for d in ("presidio", "custom_regex")])


@query("issue_types")
def issue_types(spark, sf_dir):
    found = scan.explode_findings(resolved(spark, sf_dir, "enhanced"), "doc_id")
    return found.agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("issue_types"),
                     F.count_distinct("type").alias("n_types"))


@query("token_usage")
def token_usage(spark, sf_dir):
    return summary.token_usage(conversation_texts(spark, sf_dir), "enhanced", "conv_id")


@query("avg_scan_time")
def avg_scan_time(spark, sf_dir):
    """Mean time per day and the running mean up to it. Days are summed first, so
    the running pass sees one row per day."""
    daily = read_table(spark, sf_dir, "events", "ts", "value").groupBy(
        F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"),
                                          F.count("value").alias("n"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        F.col("day").cast("string").alias("day"), F.round(F.col("total") / F.col("n"), 2)
        .alias("avg_ms"),
        F.round(F.sum("total").over(so_far) / F.sum("n").over(so_far), 2).alias("running_avg_ms"))


@query("running_scan_time")
def running_scan_time(spark, sf_dir):
    """The mean time after each scan."""
    events = read_table(spark, sf_dir, "events", "event_id", "ts", "value")
    return summary.running_mean(events, "value", "ts", "event_id").select("event_id", "n", "running_mean")


@query("usage_cost")
def usage_cost(spark, sf_dir):
    events = read_table(spark, sf_dir, "events", "user_id", "event_type", "value")
    return summary.usage_cost(events, ["user_id", "event_type"], "value", 0.002)


@query("ops_metrics")
def ops_metrics(spark, sf_dir):
    monitor.use_utc(spark)
    return monitor.metrics(read_table(spark, sf_dir, "events", "ts", "event_type", "value"))


# ---- streaming ----------------------------------------------------------------------------

@query("stream_scan")
def stream_scan(spark, sf_dir):
    def findings(texts: DataFrame) -> DataFrame:
        return scan.explode_findings(resolve.resolve(scan.scan(texts, "enhanced")), "doc_id")

    rows = monitor.read_stream(spark, sf_dir, "documents", "doc_id", "text")
    return monitor.drain_batches(rows, "stream-scan", findings).select(
        "doc_id", "type", "confidence", "start_pos", "end_pos")


def _event_stream(spark, sf_dir) -> DataFrame:
    monitor.use_utc(spark)
    return monitor.read_stream(spark, sf_dir, "events", "ts", "user_id", "event_type", "value")


@query("stream_metrics")
def stream_metrics(spark, sf_dir):
    return monitor.drain_windows(_event_stream(spark, sf_dir), "stream-metrics",
                                 lambda e: monitor.metrics(e, "1 hour"))


@query("stream_alerts")
def stream_alerts(spark, sf_dir):
    def windows(events: DataFrame) -> DataFrame:
        return monitor.alerts(monitor.metrics(events, "1 hour", "30 minutes"), 25.0)

    return monitor.drain_windows(_event_stream(spark, sf_dir), "stream-alerts", windows).select(
        "window_start", "requests", "errors", "alert")


@query("stream_sessions")
def stream_sessions(spark, sf_dir):
    return monitor.drain_windows(_event_stream(spark, sf_dir), "stream-sessions", monitor.sessions)


@query("stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    return monitor.drain_windows(_event_stream(spark, sf_dir), "stream-rates",
                                 lambda e: monitor.rate_limit_stream(e, quota=1, seconds=3600))


@query("stream_quota_sliding")
def stream_quota_sliding(spark, sf_dir):
    """``rate_limit`` of the events as a stream, second by second."""
    with stateful.own_state(spark):
        return monitor.drain_windows(_event_stream(spark, sf_dir), "stream-quota",
                                     lambda e: stateful.sliding_quota(e, quota=1, seconds=3600))


@query("stream_late_events")
def stream_late_events(spark, sf_dir):
    """Hourly windows of all events, of which every 50th comes after all others."""
    monitor.use_utc(spark)
    events = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    path = fresh_path(spark, "arriving")
    events.where("event_id % 50 <> 0").write.parquet(path)
    source = spark.readStream.schema(events.schema).parquet(path)
    with stateful.own_state(spark):
        rows = monitor.drain_to_end(
            {"ts": source}, "stream-late", lambda e: stateful.accounted_windows(e, "1 hour"),
            [lambda: events.where("event_id % 50 = 0").write.mode("append").parquet(path)])
    return stateful.corrected(rows)


@query("stream_enriched_responses")
def stream_enriched_responses(spark, sf_dir):
    """``enrich_responses`` of the same requests and responses, both as streams with times."""
    monitor.use_utc(spark)
    second = F.expr("1700000000 + 60 * cast(split_part(request_id, ':', 1) AS bigint) "
                    "+ cast(split_part(request_id, ':', 2) AS bigint)")

    def landed(rows: DataFrame, time: str) -> DataFrame:
        rows = rows.withColumn(time, F.timestamp_seconds(second))
        path = fresh_path(spark, time)
        rows.write.parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)

    served = landed(inputs.responses(spark, sf_dir).select("request_id", "body"), "responded_at")
    asked = landed(inputs.requests(spark, sf_dir).select("request_id", "body"), "scanned_at")

    def enriched(served: DataFrame, asked: DataFrame) -> DataFrame:
        served = served.withWatermark("responded_at", monitor.LATENESS)
        shaped = monitor.timed_filter(
            responses.normalize_responses(served, "request_id", "body", "responded_at"), "status = 200", "responded_at")
        scans = request_scans(asked.withWatermark("scanned_at", monitor.LATENESS), "scanned_at")
        return responses.enrich_response_stream(shaped, scans).select(*ENRICHED)

    return monitor.drain_to_end({"responded_at": served, "scanned_at": asked}, "stream-enriched", enriched)


@query("stream_stats")
def stream_stats(spark, sf_dir):
    return monitor.drain(monitor.live_stats(_event_stream(spark, sf_dir)),
                         "stream-stats", "complete")


@query("rate_limit")
def rate_limit(spark, sf_dir):
    monitor.use_utc(spark)
    return monitor.rate_limit(read_table(spark, sf_dir, "events", "ts", "user_id"), quota=1,
                              seconds=3600)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to one decision row each: join the messages, scan, resolve
    overlaps, judge, summarise."""
    return QUERIES["summary_enhanced"](spark, sf_dir)
