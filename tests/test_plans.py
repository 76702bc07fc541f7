"""What the physical plans of the headline queries must look like."""

import re

import pytest

from textwarden.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    """Exchanges other than the spreading of a small input file."""
    return [e for e in re.findall(r"Exchange (\w+)", text) if e != "RoundRobinPartitioning"]


@pytest.mark.parametrize("name", [
    "spans_enhanced", "dedupe_presidio", "summary_presidio", "policy_threshold", "redact",
    "presence_cloud", "decisions", "clean_texts", "flagged_texts", "ranked_findings",
    "issue_payload", "parse_requests", "validate_requests", "flatten_multimodal"])
def test_no_shuffle(spark, name):
    assert shuffles(plan(spark, name)) == []


@pytest.mark.parametrize("name", [
    "summary_enhanced", "summary_simple", "request_log", "token_usage", "concat_messages_space",
    "policy_any", "heuristic_scan", "ops_metrics"])
def test_one_shuffle(spark, name):
    assert shuffles(plan(spark, name)) == ["hashpartitioning"]


@pytest.mark.parametrize("name", ["clean_texts", "flagged_texts", "spans_presidio", "context_decay"])
def test_filters_do_not_repeat_the_scan(spark, name):
    # once for the table and once for the known texts added to it
    assert plan(spark, name).count("lower(text") <= 2


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, "spans_enhanced")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan(spark, "summary_enhanced")
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan(spark, "ops_metrics")


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "udf_validator" and not n.startswith("stream_")])
def test_no_python_in_plans(spark, name):
    text = plan(spark, name)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
