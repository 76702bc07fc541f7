import json

from pyspark.sql import functions as F

from textwarden.sources import requests, responses


def parsed(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    return requests.parse_requests(df)


def body(**fields):
    return json.dumps(fields)


def user(content):
    return {"role": "user", "content": content}


def test_parse(spark):
    rows = parsed(spark, ["{bad", body(messages=[]), "[1]", "5", ""]).orderBy("id").collect()
    assert [r.status for r in rows] == [400, 200, 500, 500, 400]
    assert rows[0].error == "Invalid JSON"
    all_rows = parsed(spark, ["{bad", body(messages=[])])
    assert requests.valid_requests(all_rows).count() == 1
    assert requests.quarantined(all_rows).count() == 1


def test_empty(spark):
    rows = requests.reject_empty(parsed(spark, [body(messages=[]), body(), body(messages=[user("x")])])
                                 ).orderBy("id").collect()
    assert [(r.status, r.error) for r in rows] == [
        (400, "No messages provided"), (400, "No messages provided"), (200, None)]


def test_defaults_and_ranges(spark):
    bodies = [
        body(messages=[user("x")]),
        body(messages=[user("x")], temperature=2.5, max_tokens=0, top_p=-0.1),
        body(messages=[user("x")], temperature=2.0, max_tokens=4000, top_p=0.0, stream=True, model="m"),
        body(messages=[{"role": "user"}]), body(messages=[user(None)]), body(messages=[user(5)]),
        body(messages=[{"content": "x"}]), body(),
    ]
    rows = requests.validate(parsed(spark, bodies)).orderBy("id").collect()
    assert [r.reject_reason for r in rows] == [
        [], ["temperature", "max_tokens", "top_p"], [], ["message"], ["message"], ["message"],
        ["message"], ["messages"]]
    assert (rows[0].model, rows[0].temperature, rows[0].max_tokens, rows[0].top_p, rows[0].stream) == (
        "deepseek-chat", 0.7, 1000, 1.0, False)
    assert (rows[2].model, rows[2].stream) == ("m", True)


def test_types_are_strict(spark):
    good = [user("x")]
    cases = [({"max_tokens": "abc"}, ["max_tokens"]), ({"max_tokens": 10.7}, ["max_tokens"]), ({"stream": "maybe"}, ["stream"]),
             ({"model": 5}, ["model"]), ({"model": None}, ["model"]), ({"temperature": [1]}, ["temperature"]),
             ({"temperature": None, "max_tokens": "10", "top_p": "0.5", "stream": "yes"}, []),
             ({"max_tokens": 10.0, "stream": 0}, [])]
    rows = requests.validate(parsed(spark, [body(messages=good, **f) for f, _ in cases])).orderBy("id").collect()
    assert [r.reject_reason for r in rows] == [want for _, want in cases]


def test_text_of_content(spark):
    mixed = [{"type": "text", "text": "a"}, "b", {"type": "image"}]
    bodies = [body(messages=[user("x"), user("y")]), body(messages=[{"role": "user"}]),
              body(messages=[user(None)]), body(messages=[user(mixed)]), body(messages=[user(5)]),
              body(messages=[user(True)]), body(messages=[]), body(messages=[user([])])]
    multi = requests.request_texts(parsed(spark, bodies), multimodal=True).orderBy("id").collect()
    assert [r.text for r in multi] == ["x y ", " ", "None ", "a b ", "5 ", "True ", "", ""]
    assert all(r.status == 200 for r in multi)
    plain = requests.request_texts(parsed(spark, bodies), separator="\n").orderBy("id").collect()
    assert [r.text for r in plain] == ["x\ny\n", "\n", None, None, None, None, "", None]
    assert [r.status for r in plain] == [200, 200, 500, 500, 500, 500, 200, 500]


def test_responses(spark):
    bodies = [json.dumps({"id": "r1", "created": 5, "model": "m", "choices": [
        {"index": 2, "message": {"role": "tool", "content": "hi"}, "finish_reason": "stop"}],
        "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}),
        json.dumps({"choices": [{}]}), "{}", "{bad", "[]", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    out = responses.normalize_responses(df)
    rows = out.orderBy("request_id").collect()
    assert rows[0].choices[0].asDict(True) == {
        "index": 2, "message": {"role": "tool", "content": "hi"}, "finish_reason": "stop"}
    assert rows[1].id == "resp-1" and rows[1].object == "chat.completion"
    assert rows[1].choices[0].asDict(True) == {
        "index": 0, "message": {"role": "assistant", "content": ""}, "finish_reason": None}
    assert rows[2].choices == [] and rows[2].usage.total_tokens == 0
    assert [(r.status, r.error) for r in rows] == [(200, None)] * 3 + [(500, "Internal error")] * 3
    assert rows[3].id is None and rows[4].choices is None and rows[5].usage is None
    out = out.where("status = 200")
    scans = spark.createDataFrame([(0, 2)], "request_id int, total_issues long")
    enriched = responses.enrich_responses(out, scans).orderBy("request_id").collect()
    assert enriched[0].stream_prefix == "[Security: 2 issues detected, request allowed] "
    assert [r.security_scan.issues_detected for r in enriched] == [2, 0, 0]
    assert enriched[0].security_scan.scan_summary.total_issues == 2


def test_stream_lines(spark):
    lines = [(1, 0, "data: a"), (1, 1, ": ping"), (1, 2, "  data: [DONE] "), (1, 3, "data: late"),
             (2, 0, "data: b"), (2, 1, ""), (2, 2, "data: c")]
    df = spark.createDataFrame(lines, "stream_id int, seq int, line string")
    got = sorted(tuple(r) for r in responses.sse_lines(df).collect())
    assert got == [(1, 0, "data: a"), (1, 2, "data: [DONE]"), (2, 0, "data: b"), (2, 2, "data: c")]
