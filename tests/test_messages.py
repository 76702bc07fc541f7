"""Conversations become one text each, and are scanned as such."""

import random

import pytest
from pyspark.sql import functions as F

import model
from textwarden.operators import policy, redact, resolve, scan, summary
from textwarden.plans.inputs import letters
from textwarden.rules import PROFILES
from textwarden.sources.messages import concat_messages

FRAGMENTS = [
    "hello there", "Fine, thanks.", "", " ", "password:", "= hunter22", "my password", "hunter2222 ok.",
    "4111 1111", "1111 1111", "call (555)", "123-4567", "555-123", "-----BEGIN RSA", "OPENSSH",
    "PRIVATE KEY----- done.", "Server", "= db1", "Server=db1", "Host = a b c", "; Database", "= prod",
    "; Database=prod", "Initial", "x;", "a@b.com, yes!", "123-45-6789.", "secret", "api_key=",
    f"'{letters(20)}'", letters(40), f"aws {letters(40)}", "We export data.", "the database!", "1",
    "sk-", "no. api key", "key", "data source", "y = 5;", "y = 5", "été ça va?", "a\u00a0b\x1f", "(",
]


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(11)
    convs = [[rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 25))] for _ in range(300)]
    for i, fragment in enumerate(FRAGMENTS):      # every pair next to each other
        for other in FRAGMENTS[i % 3::3]:
            convs.append(["Start.", fragment, other, "Stop.", "End!"])
    return convs


@pytest.fixture(scope="module")
def messages(spark, conversations):
    rows = [(i, t, m) for i, c in enumerate(conversations) for t, m in enumerate(c)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").cache()


@pytest.fixture(scope="module")
def texts(messages):
    return concat_messages(messages).cache()


def whole(conversation, separator=" "):
    return "".join(m + separator for m in conversation)


def test_conversations_stay_whole(messages, conversations):
    df = concat_messages(messages, "\n")
    assert df.columns == ["conv_id", "text", "n_messages"]
    for r in df.collect():
        assert r.text == whole(conversations[r.conv_id], "\n")
        assert r.n_messages == len(conversations[r.conv_id])


def test_missing_content_is_empty(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "b")], "conv_id int, turn int, text string")
    assert concat_messages(df).first().text == " b "


@pytest.mark.parametrize("profile", ["simple", "enhanced", "presidio", "advanced"])
def test_findings_match_the_model(texts, conversations, profile):
    found = scan.scan(texts, profile)
    if PROFILES[profile].dedupe:
        found = resolve.resolve(found)
    got = {}
    for r in scan.explode_findings(found, "conv_id").collect():
        got.setdefault(r.conv_id, []).append(
            (r.type, r.start_pos, r.end_pos, r.confidence, r.severity, r.context))
    for i, conv in enumerate(conversations):
        assert sorted(got.get(i, [])) == sorted(model.findings(profile, whole(conv))), conv
    rows = policy.decide_findings(found, profile, "conv_id").collect()
    assert len(rows) == len(conversations)
    for r in rows:
        assert r.blocked == model.blocked(profile, whole(conversations[r.conv_id]))
    for r in summary.summarise(found, profile, "conv_id").collect():
        want = model.findings(profile, whole(conversations[r.conv_id]))
        assert r.total_issues == len(want)
        assert r.issue_types == ",".join(sorted({f[0] for f in want}))
        assert r.max_confidence == max((f[3] for f in want), default=None)


def test_names_and_tokens_match_the_model(texts, conversations):
    for r in scan.rule_names(texts, "cloud", "conv_id").collect():
        assert r.names == model.present("cloud", whole(conversations[r.conv_id]))
    for r in summary.token_usage(texts, "simple", "conv_id").collect():
        assert r.prompt_tokens == len(whole(conversations[r.conv_id]).split())
    for r in scan.mentions(texts, "conv_id").collect():
        text = whole(conversations[r.conv_id])
        want = [name for name, sign in (
            ("potential_openai_key", "sk-" in text and len(text) > 50),
            ("potential_email", "@" in text and "." in text),
            ("api_key_mention", "api_key" in text.lower()),
            ("password_mention", "password" in text.lower())) if sign]
        assert r.names == want


def test_a_long_conversation_is_like_any_other(spark):
    """Findings, decision, log row and masking of 12,000 messages, as of a few."""
    said = ["ok thanks"] * 12_000
    said[11_990], said[11_995] = "mail u2@example.org now.", letters(40) + " aws."
    rows = [(1, t, m) for t, m in enumerate(said)]
    df = concat_messages(spark.createDataFrame(rows, "conv_id int, turn int, text string"))
    assert df.columns == ["conv_id", "text", "n_messages"] and df.count() == 1
    found = resolve.resolve(scan.scan(df, "enhanced"))
    masked = redact.redact(found).first().redacted
    got = [(r.type, r.start_pos, r.end_pos) for r in scan.explode_findings(found, "conv_id").collect()]
    assert sorted(got) == sorted((f[0], f[1], f[2]) for f in model.findings("enhanced", whole(said)))
    assert "u2@example.org" not in masked and "<EMAIL" in masked
