"""Overlap resolution and ranking of findings.

Findings are taken by start position. One that overlaps the last survivor
replaces it when its confidence is strictly higher and is dropped otherwise; a
later finding can only touch the last survivor, so one pass suffices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.spans import blocked_fold
from textwarden.operators.scan import FINDING
from textwarden.sources.tables import stored


def _sorted(findings: str, key: str) -> str:
    """Sort by ``key`` (SQL on ``f``); equal keys keep their order."""
    return (f"transform(array_sort(transform({findings}, "
            f"(f, i) -> struct({key} AS k, i AS i, f AS f))), s -> s.f)")


def ranked(findings: str) -> str:
    """Best confidence first, then text order."""
    return _sorted(findings, "-f.confidence")


def survivors(findings: str) -> str:
    """SQL that resolves overlaps inside an array of findings in scan order."""
    clash = "(x.start_pos < acc.last.end_pos AND x.end_pos > acc.last.start_pos)"
    return blocked_fold(
        _sorted(findings, "f.start_pos"), FINDING,
        {"last": (f"cast(NULL AS {FINDING})",
                  f"CASE WHEN acc.last IS NOT NULL AND {clash} "
                  f"AND x.confidence <= acc.last.confidence THEN acc.last ELSE x END")},
        item="acc.last", emit=f"acc.last IS NOT NULL AND NOT {clash}", last="acc.last")


def resolve(scanned: DataFrame, rank: bool = False) -> DataFrame:
    """Replace ``findings`` by the survivors, optionally best first."""
    kept = survivors("findings")
    return scanned.withColumn("findings", F.expr(ranked(kept) if rank else kept))


def overlap_groups(findings: DataFrame, key: str, stretch: int = 1 << 16) -> DataFrame:
    """Add ``grp``: findings of one text whose spans touch, directly or through
    others, share it. Groups never influence each other in the resolution.

    A text may own a large share of all findings, so it is never handled as one
    group: positions are cut into stretches, each stretch is scanned on its own,
    and only one small row per stretch is combined along the text.
    """
    rows = findings.withColumn("stretch", F.expr(f"start_pos div {stretch}"))
    # Range frames: findings with equal starts see the same and stay together.
    inside = Window.partitionBy(key, "stretch").orderBy("start_pos")
    along = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)

    tops = rows.groupBy(key, "stretch").agg(F.max("end_pos").alias("top")).select(
        key, "stretch", F.max("top").over(along).alias("carried"))
    rows = rows.join(tops, [key, "stretch"]).withColumn(
        "reach", F.max("end_pos").over(inside.rangeBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("start_pos") >= F.coalesce(F.greatest("reach", "carried"), F.lit(0))
    rows = rows.withColumn("begins", F.when(fresh, F.col("start_pos"))).withColumn(
        "grp", F.max("begins").over(inside.rangeBetween(Window.unboundedPreceding, 0)))

    # findings at the head of a stretch may continue a group begun in an earlier one
    heads = rows.groupBy(key, "stretch").agg(F.max("begins").alias("begins")).select(
        key, "stretch", F.max("begins").over(along).alias("continued"))
    return (rows.join(heads, [key, "stretch"])
            .withColumn("grp", F.coalesce("grp", "continued"))
            .drop("stretch", "reach", "carried", "begins", "continued"))


def resolve_table(findings: DataFrame, key: str) -> DataFrame:
    """Resolve overlaps between findings that sit in separate rows, for example
    when an external entity table is merged with rule findings.

    Copies of a finding never change the outcome and are dropped first, so a group
    holds distinct spans only. The findings are read several times, so they are
    stored: the scan that produces them runs once."""
    findings = stored(findings.distinct(), "findings")
    order = ["source", "rule_ord", "start_pos", "end_pos"]
    columns = [c.split(":")[0] for c in FINDING[len("struct<"):-1].split(",")]
    packed = F.struct(*order, F.struct(*columns).cast(FINDING).alias("f"))
    return (overlap_groups(findings, key).groupBy(key, "grp")
            .agg(F.array_sort(F.collect_list(packed)).alias("packed"))
            .select(key, F.explode(F.expr(survivors("packed.f"))).alias("f"))
            .select(key, "f.*"))
