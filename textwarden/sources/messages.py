"""Chat messages to texts: one text per conversation, in turn order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_messages(messages: DataFrame, separator: str = " ", key: str = "conv_id",
                    order: str = "turn", text: str = "text") -> DataFrame:
    """One row ``(key, text, n_messages)`` per conversation, however long; the
    separator follows every message, and missing content counts as empty.

    One shuffle by key, whose partitions adaptive execution sizes. A text is one
    value, so a conversation must fit into a row (2 GB), as a document must.
    """
    rows = messages.select(key, F.col(order).alias("turn"),
                           F.concat(F.coalesce(text, F.lit("")), F.lit(separator)).alias("text"))
    return rows.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                 lambda m: m.text), "").alias("text"),
        F.count("*").cast("long").alias("n_messages"))
