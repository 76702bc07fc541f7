import json

import pytest
from pyspark.sql import functions as F

from textwarden.operators import resolve, scan, summary
from textwarden.sources import audit, responses
from textwarden.sources.tables import read_table, spread
from textwarden.streaming import monitor, stateful

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def events(spark):
    return read_table(spark, SF, "events", "ts", "user_id", "event_type", "value")


def stream(spark):
    return monitor.read_stream(spark, SF, "events", "ts", "user_id", "event_type", "value")


def test_stream_scan_equals_batch(spark):
    def found(texts):
        return scan.explode_findings(resolve.resolve(scan.scan(texts, "advanced"), True), "doc_id")

    texts = monitor.read_stream(spark, SF, "documents", "doc_id", "text")
    want = rows(found(read_table(spark, SF, "documents", "doc_id", "text")))
    assert rows(monitor.drain(found(texts), "scan")) == want
    assert rows(monitor.drain_batches(texts, "scan", found)) == want


@pytest.mark.parametrize("build", [
    lambda e: monitor.metrics(e, "1 hour"), lambda e: monitor.metrics(e, "1 hour", "30 minutes"),
    monitor.sessions])
def test_stream_equals_batch(spark, build):
    assert rows(monitor.drain_windows(stream(spark), "s", build)) == rows(build(events(spark)))


def test_live_stats_equal_batch(spark):
    want = rows(monitor.live_stats(events(spark)))
    assert rows(monitor.drain(monitor.live_stats(stream(spark)), "s", "complete")) == want


def test_windows_over_batches_of_a_folder(spark, tmp_path):
    """Four batches in the order of time; a row far behind the watermark is late and left out."""
    for day in range(4):
        df = spark.createDataFrame([(day, h, u) for h in range(0, 24, 3) for u in (1, 2)], "d int, h int, user_id long")
        df.select(F.timestamp_seconds(F.col("d") * 86400 + F.col("h") * 3600).cast("timestamp_ntz").alias("ts"),
                  "user_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    late = spark.sql("SELECT TIMESTAMP_NTZ'1970-01-01 00:00:05' AS ts, 9L AS user_id")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    path = str(tmp_path / "events.parquet")
    source = spark.readStream.schema("ts timestamp_ntz, user_id long").option("maxFilesPerTrigger", 1).parquet(path)
    got = monitor.drain_windows(source, "folder", monitor.sessions)
    assert got.where("user_id IN (1, 2)").count() == 64 and got.where("user_id = 9").count() == 0


@pytest.mark.parametrize("seconds", [60, 3600, 7200, 86400])
def test_rate_limit_against_definition(spark, seconds):
    data = [(1, t) for t in (0, 10, 59, 60, 61, 3599, 3600, 3601, 3659, 3660, 7200)] * 2 + [(2, 3590), (2, 3610)]
    df = spark.createDataFrame(data, "user_id int, s int").select(
        "user_id", F.timestamp_seconds("s").alias("ts"))
    got = {(r.user_id, r.second): (r.requests, r.in_window, r.over_quota)
           for r in monitor.rate_limit(df, quota=4, seconds=seconds).collect()}
    for user, second in set(data):
        inside = [1 for u, s in data if u == user and second - seconds <= s <= second]
        assert got[user, second] == (data.count((user, second)), len(inside), len(inside) > 4)
    assert len(got) == len(set(data))


def test_rate_limit_stream(spark):
    got = monitor.drain(monitor.rate_limit_stream(stream(spark), 1, 86400), "rate", "complete")
    assert got.agg(F.sum("requests")).first()[0] == events(spark).count()
    assert got.where("over_quota <> (requests > 1)").count() == 0


def event_folder(spark, path, batches):
    """One file for each batch of (user, second) pairs, in the order of arrival."""
    for batch in batches:
        df = spark.createDataFrame([(u, float(t)) for u, t in batch], "user_id long, s double")
        df.select("user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), F.lit("click").alias("event_type"),
                  F.col("s").alias("value")).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def in_order(spark, path):
    schema = "user_id long, ts timestamp_ntz, event_type string, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seconds", [60, 3600, 7200])
def test_sliding_quota_equals_batch(spark, tmp_path, monkeypatch, seconds):
    """Bursts over borders of stretches, a busy user, and events that come out of order within the lateness."""
    monkeypatch.setattr(stateful, "STRETCH_SECONDS", 3600)
    path = str(tmp_path / "events")
    early = [(1, t) for t in (0, 10, 59, 60, 61, 3599, 3600.5, 3601)] + [(2, t / 7) for t in range(200)]
    mixed = [(1, t) for t in (3590, 3659, 3660, 7200, 4000, 10800)] + [(3, 7199), (3, 7201), (None, 5)]
    last = [(1, t) for t in (14400, 7300, 7190)] + [(2, 9000)] * 5
    every = event_folder(spark, path, [early, mixed, last])
    want = rows(monitor.rate_limit(every, 4, seconds))
    with stateful.own_state(spark):
        got = monitor.drain_windows(in_order(spark, path), "quota", lambda e: stateful.sliding_quota(e, 4, seconds, "2 hours"))
    assert rows(got) == want and any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_sliding_quota_goes_on_from_its_checkpoint(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("events", "out", "state"))

    def go_on():
        with stateful.own_state(spark):
            query = (stateful.sliding_quota(in_order(spark, path), 2, 600, "1 minute").writeStream.format("parquet")
                     .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
            query.awaitTermination()

    event_folder(spark, path, [[(1, t) for t in (0, 100, 200, 599)], [(1, 700), (1, 800)]])
    go_on()
    first = spark.read.parquet(out).count()
    event_folder(spark, path, [[(1, 790), (1, 1300)], [(1, 9000)]])
    go_on()
    want = {r[1]: r for r in rows(monitor.rate_limit(spark.read.parquet(path), 2, 600)) if r[1] < 9000}
    assert 0 < first < len(want) and {r[1]: r for r in rows(spark.read.parquet(out))} == want


def test_every_event_is_on_time_or_late(spark, tmp_path):
    path = str(tmp_path / "events")
    event_folder(spark, path, [[(1, 100.0 + t) for t in range(50)] + [(2, 9000.0)], [(3, 150.0), (4, 9100.0)]])
    with stateful.own_state(spark):
        out = monitor.drain_to_end(
            {"ts": in_order(spark, path)}, "late", lambda e: stateful.accounted_windows(e, "1 minute", "10 minutes"),
            [lambda: event_folder(spark, path, [[(5, 101.0), (6, 8900.0)], [(7, 102.0), (8, 20000.0)]])])
    every = spark.read.parquet(path)
    assert out.agg(F.sum("requests")).first()[0] == every.count()
    late = stateful.late_events(out, "user_id long, ts timestamp, event_type string, value double")
    assert sorted(r.user_id for r in late.collect()) == [3, 5, 7]
    fixed = stateful.corrected(out)
    want = rows(monitor.metrics(every, "1 minute").select("window_end", "requests", "errors", "error_rate_pct", "avg_response"))
    assert rows(fixed.select("window_end", "requests", "errors", "error_rate_pct", "avg_response")) == want
    assert fixed.agg(F.sum("late"), F.sum("on_time")).first() == (3, every.count() - 3)


def test_responses_meet_their_scans_on_streams(spark, tmp_path):
    def folder(name, data, columns):
        path = str(tmp_path / name)
        for batch in data:
            df = spark.createDataFrame(batch, columns)
            df.withColumn("t", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)
        return path, spark.read.parquet(path).schema

    # the scan may come before or after the answer; one is too old, one is newer than the answer, one is missing
    said = folder("said", [[("a", 100), ("b", 200)], [("c", 9000), ("d", 9100), ("e", 9200), (None, 9300)]], "request_id string, t long")
    seen = folder("seen", [[("a", 90, 2)], [("b", 200, 1), ("c", 3000, 5), ("d", 9150, 7)]], "request_id string, t long, total_issues long")

    def joined(answers, scans):
        return responses.enrich_response_stream(
            answers.withColumnRenamed("t", "responded_at"), scans.withColumnRenamed("t", "scanned_at")).select(
            "request_id", "security_scan.issues_detected", "stream_prefix")

    def stream(path, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    answers = stream(*said).withColumnRenamed("t", "responded_at")
    scans = stream(*seen).withColumnRenamed("t", "scanned_at")
    out = monitor.drain_to_end(
        {"responded_at": answers, "scanned_at": scans}, "joined",
        lambda a, s: responses.enrich_response_stream(
            a.withWatermark("responded_at", "5 minutes"), s.withWatermark("scanned_at", "5 minutes")).select(
            "request_id", "security_scan.issues_detected", "stream_prefix"))
    want = rows(joined(spark.read.parquet(said[0]), spark.read.parquet(seen[0])))
    assert rows(out.where("request_id IS NULL OR request_id <> ''")) == want
    assert [r[1] for r in want] == [2, 1, 0, 0, 0, 0]


def test_audit_sink(spark, tmp_path):
    monitor.use_utc(spark)
    path = str(tmp_path / "trail")
    records = audit.audit_records(events(spark), "ts", "user_id", "event_type")
    half = records.count()
    assert audit.append_audit(records, path, "one")
    assert not audit.append_audit(records, str(tmp_path / "off"), "one", enabled=False) and not (tmp_path / "off").exists()
    back = audit.read_audit(spark, path)
    assert back.count() == half and back.select("date").distinct().count() == 30
    first = json.loads(back.first().record)
    assert list(first) == ["timestamp", "user_id", "event_type"] and first["timestamp"].endswith("Z")
    assert not audit.append_audit(records, path, "one")         # a batch that comes again is not added again
    write = audit.audit_batch(path)
    for _ in range(2):
        write(records, 7)
    assert audit.read_audit(spark, path).count() == 2 * half


def test_audit_sink_shows_only_whole_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "trail")
    records = audit.audit_records(events(spark), "ts", "user_id")
    audit.append_audit(records, path, "one")

    class Killed(Exception):
        pass

    def die(_):
        raise Killed

    with monkeypatch.context() as patch:        # dies after its files, before its commit
        patch.setattr(audit.json, "dumps", die)
        with pytest.raises(Killed):
            audit.append_audit(records, path, "two")
    assert audit.read_audit(spark, path).select("batch").distinct().count() == 1
    assert audit.append_audit(records, path, "two")
    assert audit.read_audit(spark, path).groupBy("batch").count().select("count").distinct().collect() == [(records.count(),)]


def test_request_log(spark):
    df = spark.createDataFrame([(1, "mail a@b.com " + "y" * 200)], "id int, text string")
    r = audit.request_log(scan.scan(df, "simple"), "id", digits=2).first()
    assert r.issue_lines == ["email: HIGH (confidence: 0.85)"]
    assert (r.content_length, r.issue_count, len(r.preview)) == (213, 1, 100)


def test_payload_and_counters(spark):
    long_key = "sk-" + "a1" * 24
    df = spark.createDataFrame([(1, f"some words before it {long_key} and words after"), (2, "clean")],
                               "id int, text string")
    found = resolve.resolve(scan.scan(df, "presidio"), True)
    r = summary.issue_payload(scan.explode_findings(found, "id"), "presidio", "id").first()
    assert r.entity_text == long_key[:20] + "..." and len(r.context) == 53
    totals = summary.scan_counters(summary.summarise(found, "presidio", "id")).first()
    assert totals.asDict() == {"total_scans": 2, "presidio_scans": 0, "custom_scans": 2,
                               "issues_found": 1, "blocked_requests": 1}


def test_spread(spark):
    small = read_table(spark, SF, "documents", "doc_id", "text")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=64)
    assert spread(wide) is wide
