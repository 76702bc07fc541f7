import pytest
from pyspark.sql import functions as F

from textwarden.functions.checks import severity_sql
from textwarden.operators import entities as ent
from textwarden.operators import resolve, scan
from textwarden.operators.redact import redact
from textwarden.plans.inputs import VECTORS
from textwarden.rules import ENTITY_TYPES_APP, PROFILES

CASES = [
    ("thanks John", "PERSON", "thanks", .9, None),
    ("John Doe called", "PERSON", "John Doe", .85, "HIGH"),
    ("John Doe called", "PERSON", "John Doe", .69, None),
    ("x at 5", "DATE_TIME", "5", .9, None),
    ("open /src/app in vscode", "URL", "/src/app", .6, None),
    ("see /src/app", "URL", "/src/app", .6, "MEDIUM"),
    ("git commit by admin", "LOCATION", "admin", .85, None),
    ("John Doe called", "UNKNOWN", "John", .99, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id bigint, text string")
    rows = [(i, kind, score, t.index(e), t.index(e) + len(e))
            for i, (t, kind, e, score, _) in enumerate(CASES)]
    return spark.createDataFrame(
        rows, "doc_id bigint, entity_type string, score double, start_pos bigint, end_pos bigint"), texts


def test_postfilter(tables):
    got = {r.doc_id: r for r in ent.entity_findings(*tables).collect()}
    for i, (text, kind, entity, score, severity) in enumerate(CASES):
        assert (got[i].severity if i in got else None) == severity, CASES[i]
        if i in got:
            assert got[i].entity_text == entity.lower() and got[i].type == kind.lower()
            assert got[i].description == f"Presidio detected {kind}"


def test_advanced_takes_entities_as_they_are(tables):
    assert {r.doc_id for r in ent.entity_findings(*tables, profile="advanced").collect()} == set(range(7))


def test_labels(tables):
    labels = {r.doc_id: r.label for r in ent.entity_labels(tables[0], ENTITY_TYPES_APP, "PII detected: ").collect()}
    assert labels[1] == "PII detected: PERSON (confidence: 0.85)"
    assert 7 not in labels


def test_severity(spark):
    df = spark.createDataFrame([(.95,), (.949,), (.8,), (.6,), (.59,)], "c double")
    assert [r[0] for r in df.select(F.expr(severity_sql("c"))).collect()] == [
        "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_merged_order_on_ties(spark):
    """An external finding of equal start and confidence stays."""
    texts = spark.createDataFrame([(1, "a@b.com x")], "doc_id bigint, text string")
    entities = spark.createDataFrame(
        [(1, "EMAIL_ADDRESS", .85, 0, 7), (1, "PERSON", .99, 8, 9)],
        "doc_id bigint, entity_type string, score double, start_pos bigint, end_pos bigint")
    rows = ent.merged_findings(entities, texts).collect()
    assert [(r.detector, r.start_pos) for r in rows] == [("presidio", 0)]
    weaker = entities.withColumn("score", F.lit(.8))
    assert [r.detector for r in ent.merged_findings(weaker, texts).collect()] == ["custom_regex"]


@pytest.mark.parametrize("profile", ["presidio", "enhanced"])
def test_redaction_leaves_no_finding(spark, profile):
    texts = spark.createDataFrame(list(VECTORS.items()), "name string, text string")
    masked = redact(resolve.resolve(scan.scan(texts, profile)))
    again = scan.scan(masked.select("name", F.col("redacted").alias("text")), profile)
    assert scan.explode_findings(again, "name").count() == 0
    got = {r.name: r.redacted for r in masked.collect()}
    assert got["email_ok"] == "mail <EMAIL_ADDRESS> now"
    assert got["clean"] == VECTORS["clean"]
    hashed = redact(resolve.resolve(scan.scan(texts, profile)), "hash").where("name = 'email_ok'").first()
    assert hashed.redacted.startswith("mail <EMAIL_ADDRESS:") and "doe" not in hashed.redacted


def test_redaction_of_long_texts(spark):
    unit = "é😀 mail a@b.org, x " + "wört " * 337
    df = spark.createDataFrame([(1, unit * 20)], "id int, text string")
    masked = redact(resolve.resolve(scan.scan(df, "enhanced"))).first().redacted
    assert masked == unit.replace("a@b.org", "<EMAIL_ADDRESS>") * 20


def test_switches_remove_detectors_from_the_plan(tables):
    entities, texts = tables
    both = {r.doc_id: r for r in ent.app_decisions(entities, texts).collect()}
    assert both[1].issues[0].startswith("PII detected: PERSON") and both[1].status == 400 and both[7].status == 200
    off = ent.app_decisions(entities, texts, pii_on=False)
    assert "Join" not in off._jdf.queryExecution().executedPlan().toString() and off.where("blocked").count() == 0
    assert ent.app_decisions(entities, texts, blocking_on=False).where("blocked").count() == 0


def test_confidence_limit_and_added_validator(spark):
    df = spark.createDataFrame([(1, "a@b.org and 123-45-6789")], "id int, text string")
    found = scan.at_least(scan.scan(df, "simple"), 0.9).first().findings
    assert [f.type for f in found] == ["ssn"]
    profile = PROFILES["simple"].with_validators({"email": lambda hit: f"{hit} LIKE '%.com'"})
    assert [f.type for f in scan.scan(df, profile).first().findings] == ["ssn"]


def test_texts_with_and_without_stored_findings(spark):
    from textwarden.operators import summary
    texts = spark.createDataFrame([(1, "a@b.org a@c.org"), (2, "x")], "doc_id int, text string")
    found = scan.explode_findings(scan.scan(texts, "simple"), "doc_id")
    assert [r.doc_id for r in summary.texts_without(texts, found).collect()] == [2]
    assert [r.doc_id for r in summary.texts_with(texts, found).collect()] == [1]
