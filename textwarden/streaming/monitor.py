"""Scanning and monitoring streams of texts and request events.

The batch operators are plain column expressions, so scanning a stream is the
same code. Event tables have ``ts, user_id, event_type, value``; an ``error``
event is a failed request and ``value`` its response time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.sources.tables import fresh_path, spread

LATENESS = "1 hour"
END = "9999-01-01 00:00:00"
RATE_WINDOW_SECONDS = 60


def use_utc(spark: SparkSession) -> None:
    """Event times are UTC; windows and casts must not depend on the machine."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def read_stream(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of the folder (one file, or a folder of part files) as a stream."""
    path = f"{folder}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        rows = source.parquet(path)
    else:  # a stream reads folders, so a single file is picked from its own
        rows = source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.select(*columns) if columns else rows


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def with_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def timed_filter(rows: DataFrame, condition: str, time: str) -> DataFrame:
    """Rows with a time that fulfil ``condition`` (SQL). Rows that it drops still move the watermark: a
    plain filter is pushed below the watermark, one that needs the time itself is not."""
    return rows.where(f"CASE WHEN {time} IS NOT NULL THEN {condition} END")


def _rates() -> list[Column]:
    return [F.count("*").alias("requests"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.round(F.count_if(F.col("event_type") == "error") * 100.0 / F.count("*"), 4)
            .alias("error_rate_pct"),
            F.round(F.avg("value"), 4).alias("avg_response")]


def metrics(events: DataFrame, every: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Requests, errors and response time per (sliding) window, batch or stream."""
    if events.isStreaming:
        events = with_event_time(events).withWatermark("ts", LATENESS)
    rows = events.groupBy(F.window("ts", every, slide)).agg(*_rates())
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                       F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                       "requests", "errors", "error_rate_pct", "avg_response")


def alerts(windows: DataFrame, max_error_rate_pct: float) -> DataFrame:
    """Windows whose error rate is above the limit."""
    return windows.withColumn("alert", F.col("error_rate_pct") > max_error_rate_pct)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Requests per user session. A user is split by time through the session
    windows; partial sessions are merged before the shuffle."""
    if events.isStreaming:
        events = with_event_time(events).withWatermark("ts", LATENESS)
    rows = events.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("requests"))
    return rows.select("user_id",
                       F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
                       F.col("session_window.end").cast("timestamp_ntz").alias("session_end"),
                       "requests")


def live_stats(events: DataFrame) -> DataFrame:
    """Counters over everything seen so far."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("requests"),
        F.round(F.sum(F.col("value").cast("double")), 4).alias("total_value"))


def rate_limit(events: DataFrame, quota: int, seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Requests of each user in the ``seconds`` before and including every
    second with requests, and whether that exceeds the quota.

    Events are first counted per user and second. A busy user is split into
    stretches of time no shorter than the window; a second that the next stretch
    looks back to is copied there.
    """
    span = max(3600, seconds)
    per_second = (events.groupBy("user_id", F.unix_seconds(F.col("ts").cast("timestamp"))
                                 .alias("second")).agg(F.count("*").alias("n")))
    own = F.floor(F.col("second") / span)
    copies = F.array_distinct(F.array(own, F.floor((F.col("second") + seconds) / span)))
    rows = per_second.withColumn("stretch", F.explode(copies))
    recent = (Window.partitionBy("user_id", "stretch").orderBy("second")
              .rangeBetween(-seconds, Window.currentRow))
    return (rows.withColumn("in_window", F.sum("n").over(recent)).where(F.col("stretch") == own)
            .select("user_id", "second", F.col("n").alias("requests"), "in_window",
                    (F.col("in_window") > quota).alias("over_quota")))


def rate_limit_stream(events: DataFrame, quota: int, seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Fixed windows per user on a stream, with the verdict on each."""
    rows = (with_event_time(events).withWatermark("ts", LATENESS)
            .groupBy("user_id", F.window("ts", f"{seconds} seconds")).agg(
                F.count("*").alias("requests")))
    return rows.select("user_id",
                       F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                       "requests", (F.col("requests") > quota).alias("over_quota"))


def drain_batches(stream: DataFrame, label: str, work: Callable[[DataFrame], DataFrame],
                  spreading: bool = True) -> DataFrame:
    """Run ``work`` on every batch of a stream and return all results. A batch of
    few files is spread over the cores first; a repeated batch replaces itself."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)

    def run(batch: DataFrame, batch_id: int) -> None:
        work(spread(batch) if spreading else batch).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    (stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(run)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{path}/rows").drop("batch")


def drain_windows(events: DataFrame, label: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run windows over all available events in append mode: a window is written
    once, when the watermark has passed it, and its state goes then."""
    return drain_to_end({"ts": events}, label, build)


def drain_to_end(streams: dict[str, DataFrame], label: str, build: Callable[..., DataFrame],
                 arrivals: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Run ``build`` over all available rows of streams (by their time columns) in append mode, in one
    start, and return the result table, kept in the shared folder.

    ``arrivals`` add more input one after another, each after all before it is done. Then the input
    ends: a row of a far time in every stream closes what is still open. What that row itself opens is
    never written.
    """
    spark = next(iter(streams.values())).sparkSession
    path = fresh_path(spark, label)
    ends, ended = {}, []
    for i, (time, stream) in enumerate(streams.items()):
        folder = f"{path}/end-{i}"
        ends[folder] = spark.range(1).select(*[
            F.lit(END if f.name == time else _nothing(f.dataType)).cast(f.dataType).alias(f.name) for f in stream.schema])
        ends[folder].limit(0).write.parquet(folder)
        ended.append(stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)))
    rows = build(*ended)
    query = (rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
             .option("checkpointLocation", f"{path}/state").start())
    try:
        query.processAllAvailable()
        for arrive in arrivals:
            arrive()
            query.processAllAvailable()
        for folder, last in ends.items():
            last.write.mode("append").parquet(folder)
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def _nothing(kind: T.DataType) -> str | int | None:
    """An empty value; joins drop null keys before they look at times."""
    return "" if isinstance(kind, T.StringType) else 0 if isinstance(kind, T.NumericType) else None


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return its result table, kept
    in the shared folder. In complete mode the newest batch is the result; a repeated
    batch replaces itself."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", f"{path}/state").trigger(availableNow=True)
    target = f"{path}/rows"
    if mode == "complete":
        writer = writer.foreachBatch(
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}"))
    else:
        writer = writer.format("parquet").option("path", target)
    writer.start().awaitTermination()
    if mode == "complete":
        rows = spark.read.parquet(target)
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    return spark.read.schema(stream.schema).parquet(target)
