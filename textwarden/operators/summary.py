"""Per-text summaries, payloads, counters and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from textwarden.functions.checks import shorten_sql, tokens
from textwarden.operators.policy import blocking_sql
from textwarden.operators.scan import profile_of
from textwarden.rules import CRITICAL, HIGH, LOW, MEDIUM, Profile
from textwarden.sources.tables import stored

SEVERITIES = (CRITICAL, HIGH, MEDIUM, LOW)


def _count(condition: str) -> Column:
    return F.expr(f"cast(size(filter(findings, f -> {condition})) AS bigint)")


def summarise(scanned: DataFrame, profile: str | Profile, *keys: str) -> DataFrame:
    """One row per text with totals, severity and detector counts, the sorted
    distinct types, the best confidence and the decision."""
    profile = profile_of(profile)
    rows = scanned.select(
        *keys, F.size("findings").cast("long").alias("total_issues"),
        *[_count(f"f.severity = '{s}'").alias(s.lower()) for s in SEVERITIES],
        _count("f.detector = 'presidio'").alias("from_entities"),
        _count("f.detector = 'custom_regex'").alias("from_rules"),
        F.expr("array_sort(array_distinct(findings.type))").alias("types"),
        F.array_max("findings.confidence").alias("max_confidence"),
        F.expr(f"exists(findings, f -> {blocking_sql(profile.policy)})").alias("should_block"))
    return rows.withColumn("clean", F.col("total_issues") == 0).withColumn(
        "issue_types", F.array_join("types", ",")).drop("types")


def issue_payload(findings: DataFrame, profile: str | Profile, *keys: str) -> DataFrame:
    """What a report shows of each finding (one row per finding)."""
    name = profile_of(profile).name
    fields = [*keys, "type", "severity", "description"]
    fields.append(F.col("confidence") if name in ("advanced", "simple")
                  else F.round("confidence", 3).alias("confidence"))
    if name in ("presidio", "enhanced", "advanced"):
        fields.append("detector")
    if name == "presidio":
        fields.append(F.expr(shorten_sql("entity_text", 20)).alias("entity_text"))
    if name in ("presidio", "enhanced"):
        fields.append(F.expr(shorten_sql("context", 50)).alias("context"))
    return findings.select(*fields)


def texts_without(texts: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts that have no row in a stored findings table."""
    return texts.join(findings.select(key), key, "left_anti")


def texts_with(texts: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts that have at least one row in a stored findings table."""
    return texts.join(findings.select(key), key, "left_semi")


def _counters(with_entities: bool) -> list[Column]:
    return [F.count("*").alias("total_scans"),
            (F.count("*") if with_entities else F.count_if(F.lit(False))).alias("presidio_scans"),
            F.count("*").alias("custom_scans"),
            F.coalesce(F.sum("total_issues"), F.lit(0)).alias("issues_found"),
            F.count_if("should_block").alias("blocked_requests")]


def scan_counters(summary: DataFrame, with_entities: bool = False) -> DataFrame:
    """Totals over all scanned texts. A blocked text counts once."""
    return summary.agg(*_counters(with_entities))


def store_and_count(summary: DataFrame, label: str, with_entities: bool = False) -> tuple[DataFrame, DataFrame]:
    """The summaries, stored, and their ``scan_counters``, observed while they were written: no second
    pass. The observed stage is the one that writes, so a lost task counts once when it is repeated."""
    seen = Observation()
    kept = stored(summary.observe(seen, *_counters(with_entities)), label)
    columns = ", ".join(f"{c} long" for c in seen.get)
    return kept, summary.sparkSession.createDataFrame([tuple(seen.get.values())], columns)


def running_mean(rows: DataFrame, value: str, *order: str, scale: int = 4) -> DataFrame:
    """Add ``n`` and ``running_mean``: rows and the mean of ``value`` (a decimal of ``scale`` places, so
    that sums are exact) up to each row, in the total order of the ``order`` columns. A null counts as no
    value.

    The order is cut into ranges. One row of totals for each range gives what comes before it, and
    inside a range the totals run on: no window over all rows. The ranges are stored, so that both
    passes see the same. End ``order`` with a unique column: equal rows stay in one range.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.withColumn("_value", F.col(value).cast(f"decimal(28,{scale})"))
                    .repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    total = f"cast(0 AS decimal(38,{scale}))"
    before = (placed.groupBy("_range").agg(F.sum("_value").alias("total"), F.count("_value").alias("n"))
              .agg(F.array_sort(F.collect_list(F.struct("_range", "total", "n"))).alias("all"))  # one for each range
              .select(F.explode(F.expr(f"""transform(all, (x, i) -> struct(x._range AS _range,
                  aggregate(slice(all, 1, i), {total}, (a, y) -> cast(a + coalesce(y.total, 0) AS decimal(38,{scale}))) AS _total,
                  aggregate(slice(all, 1, i), 0L, (a, y) -> a + y.n) AS _n))""")).alias("r")).select("r.*"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.join(F.broadcast(before), "_range").select(  # as many rows as ranges
        *rows.columns, (F.count("_value").over(inside) + F.col("_n")).alias("n"),
        (F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_total")).alias("_sum"))
    return summed.withColumn("running_mean", F.when(F.col("n") > 0, F.col("_sum").cast("double") / F.col("n"))).drop("_sum")


def block_rate(decisions: DataFrame, *by: str) -> DataFrame:
    """Requests, blocked ones, and their share in percent."""
    blocked = F.count_if("blocked")
    return decisions.groupBy(*by).agg(
        F.count("*").alias("requests"), blocked.alias("blocked"),
        F.round(blocked * 100.0 / F.count("*"), 4).alias("block_rate_pct"))


def token_usage(texts: DataFrame, profile: str | Profile, *keys: str) -> DataFrame:
    """Prompt tokens (white-space separated), the profile's fixed completion
    tokens, and their sum."""
    rows = texts.select(*keys, tokens(F.col("text")).cast("long").alias("prompt_tokens"))
    completion = F.lit(profile_of(profile).completion_tokens).cast("long")
    return rows.withColumn("completion_tokens", completion).withColumn(
        "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def usage_cost(usage: DataFrame, by: list[str], tokens_column: str, price_per_1k: float) -> DataFrame:
    """Tokens and cost with subtotals for every prefix of ``by`` and in total.
    The subtotals are made from the finest sums, not from the raw rows."""
    finest = usage.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col(tokens_column).cast("double")).alias("amount"))
    amount = F.round(F.sum("amount"), 4)
    return finest.rollup(*by).agg(
        F.sum("n").alias("requests"), amount.alias("tokens"),
        F.round(amount * price_per_1k / 1000, 8).alias("cost"))
