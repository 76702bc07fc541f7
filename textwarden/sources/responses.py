"""Stored provider responses: normalising, stream lines, attaching scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.checks import strip_sql
from textwarden.sources.requests import DEFAULT_MODEL

RESPONSE = ("struct<id:string,object:string,created:bigint,model:string,"
            "choices:array<struct<index:int,message:struct<role:string,content:string>,"
            "finish_reason:string>>,"
            "usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>>")

DATA_PREFIX, STREAM_END = "data: ", "data: [DONE]"


def normalize_responses(responses: DataFrame, key: str = "request_id",
                        body: str = "body", *kept: str) -> DataFrame:
    """JSON responses to one fixed shape with defaults. An absent id is derived
    from the key, so that a rerun gives the same rows. A body that is no JSON
    object (or repeats a key) is an error row: ``status`` 500, nothing else but the
    key and the ``kept`` columns."""
    rows = responses.withColumn("r", F.from_json(body, RESPONSE)).withColumn(
        "whole", F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False)))
    shaped = _with_defaults(rows, key, *kept)
    return shaped.select(
        key, *kept, F.when(F.col("whole"), 200).otherwise(500).alias("status"),
        F.when(~F.col("whole"), "Internal error").alias("error"),
        *[F.when(F.col("whole"), F.col(c)).alias(c) for c in shaped.columns if c not in (key, *kept, "whole")])


def _with_defaults(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, "whole",
        F.coalesce("r.id", F.concat(F.lit("resp-"), F.col(keys[0]).cast("string"))).alias("id"),
        F.coalesce("r.object", F.lit("chat.completion")).alias("object"),
        F.coalesce("r.created", F.lit(0)).alias("created"),
        F.coalesce("r.model", F.lit(DEFAULT_MODEL)).alias("model"),
        F.expr("""transform(coalesce(r.choices, array()), c -> struct(
            coalesce(c.index, 0) AS index,
            struct(coalesce(c.message.role, 'assistant') AS role,
                   coalesce(c.message.content, '') AS content) AS message,
            c.finish_reason AS finish_reason))""").alias("choices"),
        F.expr("""struct(coalesce(r.usage.prompt_tokens, 0) AS prompt_tokens,
            coalesce(r.usage.completion_tokens, 0) AS completion_tokens,
            coalesce(r.usage.total_tokens, 0) AS total_tokens)""").alias("usage"))


def sse_lines(lines: DataFrame, stream: str = "stream_id", seq: str = "seq",
              line: str = "line") -> DataFrame:
    """Keep the data lines of each stream up to and including its end mark.

    The end is found by a partial aggregation, not by a window, so a stream that
    owns much of the table does not pass through one task.
    """
    clean = lines.withColumn(line, F.expr(strip_sql(line))).where(
        F.startswith(line, F.lit(DATA_PREFIX)))
    ends = clean.where(F.col(line) == STREAM_END).groupBy(stream).agg(F.min(seq).alias("end"))
    return (clean.join(ends, stream, "left")
            .where(F.col("end").isNull() | (F.col(seq) <= F.col("end"))).drop("end"))


def enrich_responses(responses: DataFrame, scans: DataFrame, key: str = "request_id",
                     entities_active: bool = False) -> DataFrame:
    """Attach what the scan found to each response, and the line that opens a
    streamed answer. ``scans`` has ``total_issues`` per key; its other columns
    are kept in ``scan_summary``."""
    return _with_scan(responses.join(_packed(scans, key), key, "left"), entities_active)


def enrich_response_stream(responses: DataFrame, scans: DataFrame, key: str = "request_id",
                           responded: str = "responded_at", scanned: str = "scanned_at",
                           within: str = "1 hour", entities_active: bool = False) -> DataFrame:
    """``enrich_responses`` while both flow, or for batches with times. A response waits for a scan of its
    request that is at most ``within`` older than itself. One that has none comes out without it, once,
    when both watermarks have passed its time; a scan is forgotten when no response can still need it.
    Streams bring watermarks on both times."""
    right = _packed(scans, key, scanned).withColumnRenamed(key, "_scan_key")
    met = F.expr(f"{key} = _scan_key AND {scanned} <= {responded} AND {scanned} >= {responded} - INTERVAL {within}")
    return _with_scan(responses.join(right, met, "left"), entities_active).drop("_scan_key", scanned)


def _packed(scans: DataFrame, *keys: str) -> DataFrame:
    found = F.struct(*[c for c in scans.columns if c not in keys]).alias("scan_summary")
    return scans.select(*keys, "total_issues", found)


def _with_scan(joined: DataFrame, entities_active: bool) -> DataFrame:
    issues = F.coalesce("total_issues", F.lit(0))
    # Names and version in the report.
    return joined.withColumn("security_scan", F.struct(
        F.lit("Microsoft Presidio + Custom Patterns").alias("detection_engine"),
        F.lit(entities_active).alias("presidio_active"),
        issues.alias("issues_detected"), F.lit("low").alias("risk_level"), "scan_summary",
        F.lit("3.0.0-presidio").alias("gateway_version"))).withColumn(
        "stream_prefix",
        F.format_string("[Security: %d issues detected, request allowed] ", issues)
    ).drop("total_issues", "scan_summary")
