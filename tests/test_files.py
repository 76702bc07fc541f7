"""JSON-line files, bucketed tables, running means, counters of a running scan, the SQL table function."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textwarden.operators import entities, resolve, scan, summary
from textwarden.rules import PROFILES
from textwarden.sources import lines
from textwarden.sources.tables import bucketed, spread
from textwarden.streaming import monitor


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def log_folder(tmp_path):
    good = [json.dumps({"request_id": f"r{i}", "messages": [{"role": "user", "content": "é" * (i % 9)}], "max_tokens": i})
            for i in range(200)]
    bad = ['{"request_id": "x', "", "  ", "[1]", '"text"', "5", '{"request_id": "y", "max_tokens": "many"}', '{"messages": 3}']
    rng = random.Random(2)
    for k in range(3):
        rows = good[k::3] + bad
        rng.shuffle(rows)
        (tmp_path / f"part-{k}.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
    return tmp_path


def check_lines(parsed, folder):
    total = sum(len(p.read_text(encoding="utf-8").splitlines()) for p in folder.glob("*.jsonl"))
    good, bad = lines.good_lines(parsed).collect(), lines.quarantine(parsed).collect()
    assert len(good) == 200 and len(good) + len(bad) == total
    assert {r.request_id for r in good} == {f"r{i}" for i in range(200)} and good[0].messages[0].role == "user"
    for r in bad:
        name = r.file.rpartition("/")[2]
        assert (folder / name).read_text(encoding="utf-8").splitlines()[r.line_number - 1] == r.line
    return sorted((r.file, r.line_number) for r in bad)


def test_lines_and_quarantine(spark, log_folder):
    whole = check_lines(lines.parse_lines(lines.lines(spark, str(log_folder))), log_folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")    # files in many blocks
    try:
        cut = lines.parse_lines(lines.lines(spark, str(log_folder)))
        assert cut.rdd.getNumPartitions() > 12
        assert check_lines(cut, log_folder) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_a_stream_equal_batch(spark, log_folder):
    def both(batch):
        parsed = lines.parse_lines(batch)
        return (lines.good_lines(parsed).select("request_id", F.lit(0).cast("long").alias("line_number"))
                .unionByName(lines.quarantine(parsed).select(F.lit("").alias("request_id"), "line_number")))

    got = monitor.drain_batches(lines.line_stream(spark, str(log_folder), 1), "lines",
                                lambda batch: both(spread(lines.numbered(batch))), spreading=False)
    want = both(lines.lines(spark, str(log_folder)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stored_tables_meet_without_a_shuffle(spark):
    texts = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = spark.range(0, 3000, 3).select((F.col("id") % 700).alias("doc_id"), F.lit("email").alias("type"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = bucketed(texts, "texts", "doc_id"), bucketed(found, "found", "doc_id")
        for choose, keep in ((summary.texts_without, False), (summary.texts_with, True)):
            df = choose(a, b)
            assert "Exchange" not in plan(df) and "SortMergeJoin" in plan(df)
            flagged = {i % 700 for i in range(0, 3000, 3)}
            assert {r.doc_id for r in df.collect()} == {i for i in range(1000) if (i in flagged) == keep}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_running_mean(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([1, 1, 1, rng.randrange(50)]), rng.choice([None, round(rng.uniform(-5, 5), 2)])) for i in range(500)]
    df = spark.createDataFrame(data, "id long, t long, v double").repartition(7)
    got = {r.id: (r.n, r.running_mean) for r in summary.running_mean(df, "v", "t", "id").collect()}
    cents, n = 0, 0
    for i, _, v in sorted(data, key=lambda r: (r[1], r[0])):
        cents, n = cents + round((v or 0) * 100), n + (v is not None)
        assert got[i][0] == n and (got[i][1] == pytest.approx(cents / 100 / n, abs=1e-9) if n else got[i][1] is None)
    assert summary.running_mean(df.where("false"), "v", "t", "id").collect() == []
    inner = plan(summary.running_mean(df, "v", "t", "id"))
    assert "SinglePartition" not in inner.partition("BroadcastExchange")[0]


def test_counters_of_a_running_scan(spark):
    df = spark.createDataFrame([(i, "mail a@b.com" if i % 3 else "clean") for i in range(50)], "id long, text string")
    rows = summary.summarise(resolve.resolve(scan.scan(df.repartition(5), "enhanced")), "enhanced", "id")
    kept, counters = summary.store_and_count(rows, "kept")
    assert counters.first().asDict() == summary.scan_counters(rows).first().asDict()
    assert kept.count() == 50


def test_sql_functions(spark):
    scan.register_scan(spark, "advanced", "findings_adv", with_context=True)
    texts = spark.createDataFrame([(1, "a@b.com and export all users"), (2, None), (3, ""), (4, "x")], "id long, text string")
    texts.createOrReplaceTempView("some_texts")
    view = spark.sql("SELECT id, f.type, f.start_pos FROM (SELECT id, findings_adv(text) AS found FROM some_texts) "
                     "LATERAL VIEW explode(found) v AS f")
    table = spark.sql("SELECT t.id, f.type, f.start_pos FROM some_texts t, LATERAL findings_adv_rows(t.text) f")
    assert "Python" not in plan(view) and "Exchange" not in plan(view) and "Python" not in plan(table)
    want = scan.explode_findings(scan.scan(texts, "advanced", True), "id").select("id", "type", "start_pos")
    for df in (view, table):
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) and df.count() == 2


@pytest.mark.parametrize("profile", ["presidio", "advanced"])
def test_merging_in_a_row_equals_merging_tables(spark, profile):
    rng = random.Random(8)
    text = "John Smith wrote a@b.com, 555-123-4567 or /src/app in git; card 4111 1111 1111 1111 " * 3
    texts = spark.createDataFrame([(i, text[i:], 1) for i in range(40)] + [(99, None, 1), (98, "", 1)], "doc_id long, text string, _entities int")
    found = [(i, rng.choice(["PERSON", "URL", "NRP", "DATE_TIME", "EMAIL_ADDRESS", "US_SSN"]), rng.choice([.5, .7, .85, .99]), a, a + rng.randrange(1, 25))
             for i in range(40) for a in (rng.randrange(150) for _ in range(12))]
    ents = spark.createDataFrame(found * 2 + [(7, "URL", .9, 0, 5), (1234, "URL", .9, 0, 5)],
                                 "doc_id long, entity_type string, score double, start_pos long, end_pos long")
    external = entities.entity_findings(ents, texts, profile)
    own = scan.explode_findings(scan.scan(texts.select("doc_id", "text"), profile), "doc_id")
    want = resolve.resolve_table(external.unionByName(own), "doc_id")
    rows = entities.merged(ents, texts, profile)
    assert rows.columns == ["doc_id", "text", "_entities", "findings"] and rows.count() == 42
    got = entities.merged_findings(ents, texts, profile)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_merging_shuffles_each_side_once(spark):
    texts = spark.range(10).selectExpr("id AS doc_id", "string(id) AS text")
    ents = spark.range(10).selectExpr("id AS doc_id", "'URL' AS entity_type", "0.9D AS score", "0L AS start_pos", "1L AS end_pos")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(entities.merged_findings(ents, texts)).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_scan_leaves_columns_of_any_name_alone(spark):
    df = spark.createDataFrame([(1, "mail a@b.com", 5, 6, 7)], "id long, text string, _lowered int, _folds int, _probe0 int")
    row = scan.scan(df, PROFILES["presidio"]).first()
    assert (row._lowered, row._folds, row._probe0, len(row.findings)) == (5, 6, 7, 1)
