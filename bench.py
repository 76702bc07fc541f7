"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion (every output column is computed and dropped):
once cold, then warm; the warm time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from textwarden.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "summary_enhanced", "summary_simple", "summary_presidio", "summary_advanced", "spans_enhanced",
    "spans_presidio", "presence_cloud", "presence_minimal", "dedupe_enhanced", "policy_high80",
    "redact", "merged_findings", "clean_texts", "token_usage", "concat_messages_space",
    "parse_requests", "flatten_multimodal", "hits_per_rule", "scan_stats", "usage_cost",
    "ops_metrics", "rate_limit", "stream_scan", "stream_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    warm, cold = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "count(*) AS n", "sum(octet_length(text)) / 1e6 AS mb").first()
    rates = {name: {"texts_per_sec": round(texts.n / warm[name]),
                    "mb_per_sec": round(texts.mb / warm[name], 1)}
             for name in ("spans_enhanced", "spans_presidio", "presence_cloud", "presence_minimal")}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "rates": rates, "cores": int(cpus),
        "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
