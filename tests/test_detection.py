import re

import pytest
from pyspark.sql import functions as F

import model
from textwarden.functions.dialect import RARE_WORD_CHARACTERS, jvm_regex
from textwarden.functions.spans import match_spans
from textwarden.operators import policy, resolve, scan
from textwarden.plans.inputs import VECTORS, letters
from textwarden.rules import HIGH, PATTERNS, PROFILES, Pattern, Rule

SPAN_PROFILES = ("presidio", "advanced", "enhanced", "simple")
NAME_PROFILES = ("cloud", "railway", "minimal")

# issues per text and profile: presidio advanced enhanced simple cloud railway minimal heuristic;
# B marks a blocked request
EXPECTED = """
openai_ok 1B 1B 1B 1B 1B 1B 1B 1B
openai_40 0 1 0 0 0 0 0 0
openai_60 1B 1B 1B 1B 1B 1B 1B 1B
anthropic_ok 1B 1B 1B 1B 1B 1B 0 1B
github_ok 1B 0 1B 1B 1B 1B 0 0
aws_ok 1B 1B 1B 1B 1B 1B 0 0
aws_lower 1B 1B 1B 1B 1B 1B 0 0
aws_15 0 0 0 0 0 0 0 0
google_ok 1B 0 1B 0 0 0 0 0
db_ok 1B 1B 1B 2B 2B 1B 1B 1B
db_redis 1 1B 1B 1B 2B 1B 1B 1B
db_amqp 1 1B 1B 1B 2B 1B 1B 1B
conn_ok 0 0 0 1B 0 0 0 0
jwt_ok 1 1B 1B 1B 1B 1B 0 0
pk_ok 1B 1B 1B 1B 1B 1B 0 0
pk_plain 0 0 0 0 0 0 0 0
slack_ok 1B 1 1B 1 0 0 0 0
discord_ok 1B 0 1B 0 0 0 0 0
email_ok 1 1B 1B 1B 1B 1B 1B 1B
email_pipe 1 1B 1B 1B 1B 1B 1B 1B
email_bad 0 0 0 0 0 0 0 0
phone_dash 1 1 1 1 1B 1B 1B 0
phone_plus 1 1 1 1 0 0 0 0
phone_paren 1 1 1 1 0 0 0 0
phone_glued 1 1 1 1 1B 1B 1B 0
ssn_ok 1 1B 1B 1B 1B 1B 0 0
ssn_no 0 0 0 0 0 0 0 0
card_ok 1 1 1 1 1B 1B 0 0
card_bad 0 0 0 0 1B 1B 0 0
pw_ok 0 0 1B 1B 1B 1B 0 1B
pw_6 0 0 1B 1B 0 0 0 1B
pw_5 0 0 0 0 0 0 0 1B
secret_8 0 0 0 1B 0 0 0 0
secret_20 0 0 0 1B 1B 0 1B 0
apikey_16 0 0 1 1 0 0 0 1B
apikey_20 0 0 0 0 1B 1B 1B 1B
ip_10 0 0 1 1 0 0 0 0
ip_172 0 0 1 1 0 0 0 0
ip_172_no 0 0 0 0 0 0 0 0
ip_192 0 0 1 1 0 0 0 0
aws40 0 1B 0 0 0 0 0 0
aws40_noctx 0 1 0 0 0 0 0 0
aws80 0 2 0 0 0 0 0 0
two 3 3B 3B 3B 2B 2B 1B 1B
exfil 0 0 0 0 0 0 0 1B
clean 0 0 0 0 0 0 0 0
doc_clean 0 0 0 0 0 0 0 0
doc_email 1 1B 1B 1B 1B 1B 1B 1B
doc_key40 0 1 0 0 0 0 0 1B
doc_key16 0 0 0 0 0 0 0 0
doc_pw 0 0 0 0 0 0 0 1B
doc_ssn 1 1B 1B 1B 1B 1B 0 0
doc_three 3 3B 3B 3B 3B 3B 2B 1B
doc_two 2 2B 2B 2B 2B 2B 2B 1B
decay 0 3 0 0 0 0 0 0
"""
OUTCOMES = {line.split()[0]: line.split()[1:] for line in EXPECTED.split("\n") if line}

# Raw spans of single patterns.
RAW = [("openai_ok", "openai_key", [(4, 55)]), ("anthropic_ok", "base64_40", [(7, 47), (47, 87)]),
       ("db_ok", "database_url", [(4, 42)]), ("db_ok", "email", [(21, 32)]),
       ("phone_plus", "phone", [(6, 22)]), ("phone_glued", "phone_dashed", [(1, 15)]),
       ("phone_paren", "phone", [(6, 19)]), ("ip_10", "private_ip", [(5, 11)]),
       ("conn_ok", "connection_string", [(0, 25)]), ("secret_20", "secret_assignment", [(3, 30)]),
       ("secret_20", "generic_secret", [(0, 30)]), ("apikey_20", "generic_api_key", [(0, 36)]),
       ("two", "email", [(0, 7), (25, 32)]), ("card_ok", "card_flat", [(5, 24)])]

UNICODE = [
    "éjohn@x.com", "john@x.comé", "é123-45-6789", "²123-45-6789", "_123-45-6789",
    "a\u0301john@x.com b", "ssn ١٢٣-٤٥-٦٧٨٩ x", "password\u00a0=\u2003hunter22",
    "password\x1f:\x1chunter22", "pa\u017f\u017fword=hunter22", "A\u212aIA0123456789ABCDEF",
    "AKIA0123456789ABCDE\u212a", "ap\u0131_key=abcdefghij0123456789", "ap\u0130key: abcdefghij0123456789",
    "😀 mail a@b.org 😀😀 and c@d.org", "card ٤١١١ ١١١١ ١١١١ ١١١١", "mysql://ü:ñ@h:1/dbé",
    "10.1.2.3\u0301", "x\u2028555-123-4567\u2029", "Server\u0085= a;\u3000Database =b\n\nc;d",
    "\U0001D400john@x.com", "john@x.com\U00020000", "\U00020000\u0301123-45-6789", "\U0001D7D8123-45-6789",
    "\u200d555-123-4567 \u203f555-123-4567 \u24b6555-123-4567 \u00b2a@b.cd",
    "secret='abcd1234'\"; [secret: &&&&&&&&]",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(VECTORS.items()), "name string, text string").cache()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_character_classes_equal_python(spark):
    """Every code point of the common planes."""
    points = spark.range(1, 0x3000).select(
        "id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    for regex in (r"\s", r"\d", "[a-z]", "[A-Z0-9]", "s", "k", "i", r"[^:\s]", r"[a-zA-Z0-9\-_!@#$%^&*()]"):
        jvm = jvm_regex(regex)
        mine = {r.id for r in points.where(F.col("c").rlike(f"{jvm[:5]}^(?:{jvm[5:]})\\z")).collect()}
        theirs = {c for c in range(1, 0x3000) if re.fullmatch(regex, chr(c), re.I)}
        assert mine == theirs, regex


def test_plain_boundary_only_differs_at_rare_characters(spark):
    """A boundary next to a letter, for every code point of the common planes."""
    points = spark.range(1, 0x30000).where("id < 55296 OR id >= 57344").select(
        "id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    exact, plain = jvm_regex(r"\ba"), jvm_regex(r"\ba", plain_boundary=True)
    both = F.concat("c", F.lit("a"))
    assert points.where(both.rlike(exact) != both.rlike(plain)).where(
        ~F.col("c").rlike(RARE_WORD_CHARACTERS)).count() == 0


def test_raw_spans(spark, texts):
    for name, key, expected in RAW:
        row = texts.where(F.col("name") == name).select(
            match_spans("text", PATTERNS[key]).alias("s")).first()
        assert [(s.start_pos, s.end_pos) for s in row.s] == expected, (name, key)


@pytest.mark.parametrize("key", list(PATTERNS))
def test_pattern_equals_python(spark, key):
    samples = list(VECTORS.values()) + UNICODE + [" ".join(VECTORS.values())]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "id int, text string")
    got = {r.id: [(s.start_pos, s.end_pos, s.hit) for s in r.s] for r in
           df.select("id", match_spans("text", PATTERNS[key]).alias("s")).collect()}
    for i, text in enumerate(samples):
        want = [(m.start(), m.end(), m.group()) for m in model.matches(PATTERNS[key], text)]
        assert got[i] == want, (key, text)


@pytest.mark.parametrize("profile", SPAN_PROFILES)
def test_findings_and_decisions(spark, texts, profile):
    prof = PROFILES[profile]
    found = scan.scan(texts, profile)
    if prof.dedupe:
        found = resolve.resolve(found, prof.rank)
    column = SPAN_PROFILES.index(profile)
    for r in policy.decide_findings(found, profile, "name").collect():
        if r.name not in OUTCOMES:
            continue
        want = OUTCOMES[r.name][column]
        assert f"{r.total_issues}{'B' if r.blocked else ''}" == want, (profile, r.name)
        assert r.status == (400 if r.blocked else 200)
        assert r.blocked == model.blocked(profile, VECTORS[r.name])
    for r in found.collect():
        got = [(f.type, f.start_pos, f.end_pos, f.confidence, f.severity, f.context)
               for f in r.findings]
        assert got == model.findings(profile, r.text), r.name


@pytest.mark.parametrize("profile", NAME_PROFILES)
def test_names_and_decisions(spark, texts, profile):
    column = 4 + NAME_PROFILES.index(profile)
    named = scan.rule_names(texts, profile, "name")
    rows = policy.decide_names(named, profile).collect()
    for r in rows:
        assert r.issues == model.present(profile, VECTORS[r.name])
        if r.name in OUTCOMES:
            want = OUTCOMES[r.name][column]
            assert f"{len(r.issues)}{'B' if r.blocked else ''}" == want, (profile, r.name)
    allowed = policy.decide_names(named, profile, blocking_on=False).where("blocked").count()
    assert (allowed > 0) == (profile == "minimal")


def test_heuristics(spark, texts):
    for r in scan.mentions(texts, "name").collect():
        if r.name in OUTCOMES:
            assert bool(r.names) == (OUTCOMES[r.name][7] == "1B"), r.name


def test_confidence_decay(spark, texts):
    r = scan.scan(texts.where("name = 'decay'"), "advanced").first()
    assert [f.confidence for f in r.findings if f.type == "aws_secret_key"] == [0.4, 0.2, 0.2]


def test_exfiltration_swallows_weaker_findings(spark):
    text = "export users, mail a@b.com or call 555-123-4567 now"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = resolve.resolve(scan.scan(df, "advanced", with_context=True), rank=True).first().findings
    assert [(f.type, f.confidence) for f in found] == [("email_address", 0.8), ("phone_number", 0.7)]
    alone = spark.createDataFrame([(1, "download the database, call 555-123-4567")], "id int, text string")
    found = resolve.resolve(scan.scan(alone, "advanced", with_context=True)).first().findings
    assert [(f.type, f.start_pos, f.end_pos) for f in found] == [("potential_data_exfiltration", 0, 40)]


def test_custom_rules_come_first_and_builtins_override(spark):
    token = Rule("custom_token", Pattern(r"ct_[0-9]{4}"), 0.9, HIGH, "Custom",
                 validator=lambda hit: f"NOT endswith({hit}, '0')")
    shadow = Rule("ssn", Pattern("x"), 0.1, HIGH, "")
    profile = PROFILES["advanced"].with_rules([shadow, token])
    assert [r.name for r in profile.rules][:3] == ["ssn", "custom_token", "aws_access_key_id"]
    df = spark.createDataFrame([(1, "ct_1234 ct_1230 x 123-45-6789")], "id int, text string")
    found = scan.scan(df, profile).first().findings
    assert [(f.type, f.entity_text) for f in found] == [("ssn", "123-45-6789"), ("custom_token", "ct_1234")]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@example.org" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = resolve.resolve(scan.scan(df, "presidio")).first().findings
    assert [(f.start_pos, f.end_pos) for f in found] == [
        (m.start(), m.end()) for m in model.matches(PATTERNS["email"], text)]


def test_long_texts(spark):
    """Texts of many chunks, with characters of one to four bytes."""
    unit = "é😀 mail a@b.org, 4111 1111 1111 1111; call 555-123-4567 " + "wört " * 37
    text = unit * 120
    hidden = text + f"Server = x{'y' * 9000}; Database=z" + letters(80)
    df = spark.createDataFrame([(1, text), (2, hidden)], "id int, text string")
    for profile in ("simple", "advanced"):
        for r in scan.scan(df, profile).collect():
            got = [(f.type, f.start_pos, f.end_pos, f.confidence, f.severity, f.context) for f in r.findings]
            assert got == model.scan(profile, r.text)


def test_scan_is_one_narrow_pass(spark, texts):
    plan = scan.explode_findings(scan.scan(
        spark.range(5).selectExpr("id", "concat('a', id) AS text"), "enhanced"), "id"
    )._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    bounded = sum("\\b" in r.pattern.regex for r in PROFILES["enhanced"].rules)
    assert plan.count("split(text") == len(PROFILES["enhanced"].rules) + bounded   # evaluated once
