"""Mask findings in their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.checks import chunks_sql, cut_sql
from textwarden.functions.spans import blocked_fold


def redact(resolved: DataFrame, mask: str = "type", text: str = "text") -> DataFrame:
    """Add ``redacted``: every finding replaced by ``<TYPE>`` or, with
    ``mask="hash"``, by ``<TYPE:`` and the start of its SHA-256 ``>``.

    Needs findings without overlaps in text order (``resolve(..., rank=False)``).
    """
    label = "upper(x.type)"
    hit = cut_sql("c", "x.start_pos", "(x.end_pos - x.start_pos)")
    cover = (f"concat('<', {label}, '>')" if mask == "type"
             else f"concat('<', {label}, ':', left(sha2({hit}, 256), 12), '>')")
    parts = blocked_fold(
        "findings", "string", {"pos": ("0L", "x.end_pos")},
        f"concat({cut_sql('c', 'acc.pos', '(x.start_pos - acc.pos)')}, {cover})",
        last=cut_sql("c", "acc.pos", f"(length({text}) - acc.pos)"))
    return resolved.withColumn("redacted", F.expr(
        f"CASE WHEN size(findings) = 0 THEN {text} "
        f"ELSE array_join(transform(array({chunks_sql(text)}), c -> array_join({parts}, '')), '') END"))
