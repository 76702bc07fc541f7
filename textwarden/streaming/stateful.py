"""Operators on streams that keep state of their own: sliding quotas, and windows that account for late events.

Both run as ``transformWithState`` processors, whose state lives in RocksDB next to the checkpoint.
Start them inside ``own_state(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textwarden.streaming.monitor import LATENESS, RATE_WINDOW_SECONDS, with_event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Rows of a window are dealt to so many keys, so that one busy window is not one task; a busy stream takes more.
SHARDS = 4
# A key holds so many seconds of a user at most: each key costs a few calls, each second a row.
STRETCH_SECONDS = 30 * 86400


@contextmanager
def own_state(spark: SparkSession):
    """Streams started inside keep the state that ``transformWithState`` needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class SlidingSums(StatefulProcessor):
    """Per user and stretch of time: the requests in the ``seconds`` up to each second with requests.

    Seconds arrive once each, counted, when the watermark has passed them; a batch never holds an
    earlier second than one before it. So a verdict is final when it is written, and only the last
    ``seconds`` need to be kept. A timer clears them when no later second can look back to them.
    """

    def __init__(self, seconds: int, span: int, quota: int):
        self.seconds, self.span, self.quota = seconds, span, quota

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "second long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        new = pd.concat(rows)[["second", "n"]].astype("int64").sort_values("second")
        known = np.array([tuple(r) for r in self.recent.get()], np.int64).reshape(-1, 2)
        both = np.concatenate([known, new.to_numpy()])
        both = both[np.argsort(both[:, 0], kind="stable")]
        total = np.concatenate([[0], np.cumsum(both[:, 1])])
        second = new["second"].to_numpy()
        first = np.searchsorted(both[:, 0], second - self.seconds)
        inside = total[np.searchsorted(both[:, 0], second, "right")] - total[first]
        keep = both[both[:, 0] >= both[-1, 0] - self.seconds]
        self.recent.put([tuple(map(int, r)) for r in keep])
        self.handle.registerTimer(int(both[-1, 0] + self.seconds + 1) * 1000)
        own = second // self.span == key[1]
        yield pd.DataFrame({"user_id": pd.Series([key[0]] * int(own.sum()), dtype="Int64"), "second": second[own],
                            "requests": new["n"].to_numpy()[own], "in_window": inside[own],
                            "over_quota": inside[own] > self.quota})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        last = max((r[0] for r in self.recent.get()), default=None)
        if last is None or (last + self.seconds + 1) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def sliding_quota(events: DataFrame, quota: int, seconds: int = RATE_WINDOW_SECONDS,
                  lateness: str = LATENESS) -> DataFrame:
    """``rate_limit`` on a stream: for each user and second with requests, the requests in the
    ``seconds`` before and including it, and whether they exceed the quota.

    Events are counted per user and second before they are shuffled, so a busy user costs a row a
    second. A user is split into stretches of time, as in the batch form; a second that the next
    stretch looks back to goes to both. Events may come out of order up to ``lateness``; a row is
    written when the watermark passes its second and never changes.
    """
    span = max(STRETCH_SECONDS, seconds)
    counted = (with_event_time(events).withWatermark("ts", lateness)
               .groupBy("user_id", F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("n"))
               .select("user_id", F.unix_seconds("w.start").alias("second"), "n"))
    copies = F.array_distinct(F.array(F.floor(F.col("second") / span), F.floor((F.col("second") + seconds) / span)))
    return (counted.withColumn("stretch", F.explode(copies)).groupBy("user_id", "stretch")
            .transformWithStateInPandas(
                SlidingSums(seconds, span, quota),
                "user_id long, second long, requests long, in_window long, over_quota boolean", "append", "EventTime"))


class AccountedWindows(StatefulProcessor):
    """Per window (and shard): sums of the events that came while it was open; later ones one by one."""

    SUMS = ("requests", "errors", "total", "measured")

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "requests long, errors long, total double, measured long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        late = key[1] <= timerValues.getCurrentWatermarkInMs()
        sums = self.sums.get() if not late and self.sums.exists() else (0, 0, 0.0, 0)
        for part in rows:
            events = pd.DataFrame({
                "window_end": part["end_ms"], "late": True, "requests": 1,
                "errors": (part["event_type"] == "error").astype("int64"), "total": part["value"].fillna(0.0),
                "measured": part["value"].notna().astype("int64"), "row": part["row"]})
            if late:
                yield events
            else:
                sums = tuple(type(a)(a + events[c].sum()) for a, c in zip(sums, self.SUMS, strict=True))
        if not late:
            self.sums.update(sums)
            self.handle.registerTimer(key[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        if self.sums.exists():
            sums = self.sums.get()
            self.sums.clear()
            yield pd.DataFrame({"window_end": [key[1]], "late": [False], **{c: [x] for c, x in zip(self.SUMS, sums, strict=True)},
                                "row": pd.Series([None], dtype="object")})

    def close(self) -> None:
        pass


def accounted_windows(events: DataFrame, every: str = "1 minute", lateness: str = LATENESS,
                      shards: int = SHARDS) -> DataFrame:
    """Every event of a stream, in a window's sums or as a late row of its own.

    Rows with ``late`` false are sums over the events that came before the watermark passed the end of
    their window; there is one for each window and shard. Rows with ``late`` true are single events
    that came after, whole, as JSON in ``row``. Nothing is left out: the sum of ``requests`` is the
    number of events. ``corrected`` brings both together.
    """
    timed = with_event_time(events).withColumn("row", F.to_json(F.struct(*events.columns)))
    marked = timed.withWatermark("ts", lateness).withColumn("w", F.window("ts", every))
    # times as numbers: a column that is tied to the watermark would lose its late rows on the way
    keyed = marked.select(
        F.unix_millis("w.end").alias("end_ms"), F.expr(f"pmod(xxhash64(row), {shards})").alias("shard"),
        "event_type", F.col("value").cast("double").alias("value"), "row")
    return (keyed.groupBy("shard", "end_ms").transformWithStateInPandas(
        AccountedWindows(),
        "window_end long, late boolean, requests long, errors long, total double, measured long, row string",
        "append", "EventTime").withColumn("window_end", F.timestamp_millis("window_end")))


def late_events(accounted: DataFrame, schema: str) -> DataFrame:
    """The events that came too late for their window, with the columns they had."""
    return accounted.where("late").select(F.from_json("row", schema).alias("e")).select("e.*")


def corrected(accounted: DataFrame) -> DataFrame:
    """One row for each window: what it held when it was closed, what came late, and both together."""
    def total(column: str, late: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.expr(late), F.col(column))), F.lit(0))

    rows = accounted.groupBy("window_end").agg(
        total("requests", "NOT late").alias("on_time"), total("requests", "late").alias("late"),
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
        F.sum("total").alias("value"), F.sum("measured").alias("measured"))
    return rows.select(
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "on_time", "late", "requests", "errors",
        F.round(F.col("errors") * 100.0 / F.col("requests"), 4).alias("error_rate_pct"),
        F.round(F.col("value") / F.col("measured"), 4).alias("avg_response"))
