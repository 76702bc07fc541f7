"""When do findings block a request, and what is answered then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.checks import strip_sql
from textwarden.functions.spans import quote
from textwarden.operators.scan import profile_of
from textwarden.rules import CRITICAL, HARMLESS_WORDS, HIGH, Profile

BLOCK_THRESHOLD = 0.8
BLOCKED_ERROR = "Request blocked due to security policy violations"


def blocking_sql(policy: str, f: str = "f", threshold: float = BLOCK_THRESHOLD,
                 blocking_on: bool = True) -> str:
    """Condition under which one finding ``f`` blocks the request."""
    critical = f"{f}.severity = '{CRITICAL}'"
    if policy == "any":
        return "true"
    if policy == "flag":
        return "true" if blocking_on else "false"
    if policy == "high80":
        return f"({critical} OR ({f}.severity = '{HIGH}' AND {f}.confidence >= 0.8D))"
    if policy == "threshold":
        return f"({critical} OR {f}.confidence >= {threshold}D)"
    if policy == "high95":
        word = strip_sql(f"lower({f}.entity_text)")
        harmless = ", ".join(quote(w) for w in HARMLESS_WORDS)
        return (f"({critical} OR ({f}.severity = '{HIGH}' AND {f}.confidence >= 0.95D "
                f"AND length({word}) > 3 AND {word} NOT IN ({harmless})))")
    raise ValueError(f"unknown policy: {policy}")


def is_blocked(policy: str, findings: str = "findings", **options) -> Column:
    """Does any finding of the array block?"""
    return F.expr(f"exists({findings}, f -> {blocking_sql(policy, 'f', **options)})")


def decide_names(named: DataFrame, profile: str | Profile, blocking_on: bool = True,
                 prefix: str = "") -> DataFrame:
    """Decision rows for profiles that report rule names (column ``names``)."""
    active = blocking_on or profile_of(profile).policy == "any"
    blocked = (F.size("names") > 0) & F.lit(active)
    return named.select(
        *[c for c in named.columns if c != "names"],
        F.when(blocked, 400).otherwise(200).alias("status"), blocked.alias("blocked"),
        F.when(blocked, BLOCKED_ERROR).alias("error"),
        F.transform("names", lambda n: F.concat(F.lit(prefix), n)).alias("issues"))


def decide_findings(scanned: DataFrame, profile: str | Profile, *keys: str, **options) -> DataFrame:
    """Decision rows for profiles that report findings."""
    policy = profile_of(profile).policy
    rows = scanned.select(*keys, F.size("findings").alias("total_issues"),
                          is_blocked(policy, **options).alias("blocked"))
    return rows.select(
        *keys, F.when(F.col("blocked"), 400).otherwise(200).alias("status"), "blocked",
        F.when(F.col("blocked"), BLOCKED_ERROR).alias("error"),
        F.col("total_issues").cast("long").alias("total_issues"))
