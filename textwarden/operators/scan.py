"""Detection: turn a text column into rule names or findings.

A text table has a key and a ``text`` column. Everything here is one narrow
projection: no shuffle, no Python, one row in and one row out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.checks import (VALIDATORS, any_word_sql, chunks_sql, severity_sql,
                                         window_sql)
from textwarden.functions.spans import (Prepared, blocked_fold, gaps_and_hits, match_spans_sql,
                                        matches_sql, pairs_sql, quote)
from textwarden.rules import HIGH, PROFILES, Profile, Rule

FINDING = ("struct<source:int,rule_ord:int,type:string,description:string,confidence:double,"
           "start_pos:bigint,end_pos:bigint,severity:string,context:string,detector:string,"
           "entity_text:string>")
FINDINGS = f"array<{FINDING}>"

# Order of detector outputs before overlaps are resolved.
FROM_ENTITIES, FROM_RULES, FROM_CONTEXT = 0, 1, 2

CONTEXT_MARGIN = 20
REQUIRED_CONTEXT_MARGIN = 50


def profile_of(profile: str | Profile) -> Profile:
    return PROFILES[profile] if isinstance(profile, str) else profile


def finding_sql(**values: str) -> str:
    """A finding struct; every value is SQL."""
    names = [f.split(":")[0] for f in FINDING[len("struct<"):-1].split(",")]
    return "struct(" + ", ".join(f"{values[n]} AS {n}" for n in names) + ")"


def _prepared(profile: Profile, text: str, texts: DataFrame) -> Prepared:
    return Prepared([r.pattern for r in profile.rules], text, texts.columns)


def rule_names(texts: DataFrame, profile: str | Profile, *keys: str,
               text: str = "text") -> DataFrame:
    """``names`` per text: the rules that occur, in catalogue order."""
    profile = profile_of(profile)
    prepared = _prepared(profile, text, texts)
    present = F.expr("array_compact(array(" + ", ".join(
        f"CASE WHEN {matches_sql(text, r.pattern, prepared)} THEN {quote(r.name)} END"
        for r in profile.rules) + "))")
    return prepared.add(texts).select(*keys, present.alias("names"))


def flag_texts(texts: DataFrame, profile: str | Profile, *keys: str,
               text: str = "text") -> DataFrame:
    """``blocked`` per text: whether any rule occurs; stops at the first one."""
    profile = profile_of(profile)
    prepared = _prepared(profile, text, texts)
    anything = F.expr("(" + " OR ".join(
        matches_sql(text, r.pattern, prepared) for r in profile.rules) + ")")
    return prepared.add(texts).select(*keys, anything.alias("blocked"))


def mentions(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``names`` per text from substring heuristics, in fixed order."""
    signs = {"sk": f"contains({text}, 'sk-')", "at": f"contains({text}, '@')",
             "dot": f"contains({text}, '.')", "api_key": f"contains(lower({text}), 'api_key')",
             "password": f"contains(lower({text}), 'password')"}
    rows = texts.select(*keys, F.length(text).cast("long").alias("size"),
                        *[F.expr(sql).alias(sign) for sign, sql in signs.items()])
    return rows.select(*keys, F.expr("""array_compact(array(
        CASE WHEN sk AND size > 50 THEN 'potential_openai_key' END,
        CASE WHEN at AND dot THEN 'potential_email' END,
        CASE WHEN api_key THEN 'api_key_mention' END,
        CASE WHEN password THEN 'password_mention' END))""").alias("names"))


def _rule_table(profile: Profile) -> str:
    """What a finding needs to know about its rule, as a constant array."""
    def row(rule: Rule) -> str:
        if profile.name == "recognizers":
            # entity findings: type and severity come from the entity and its score
            kind, note = rule.description.lower(), f"Presidio detected {rule.description}"
            severity = severity_sql(f"{rule.confidence}D")
        else:
            kind, note, severity = rule.name, rule.description, quote(rule.severity)
        words = ", ".join(quote(w) for w in rule.context_words)
        return (f"struct({quote(kind)} AS type, {quote(note)} AS description, "
                f"{severity} AS severity, {rule.confidence}D AS confidence, "
                f"cast(array({words}) AS array<string>) AS words)")
    return "array(" + ", ".join(row(r) for r in profile.rules) + ")"


def _accepts(profile: Profile) -> str:
    """Condition on rule ``r`` and match ``x.hit`` that all validators pass."""
    checks = {}
    for order, rule in enumerate(profile.rules):
        if rule.validator is not None:
            checks.setdefault(rule.validator, []).append(str(order))
    return " AND ".join(
        f"(r.ord NOT IN ({', '.join(orders)}) OR {VALIDATORS.get(check, check)('x.hit')})"
        for check, orders in checks.items()) or "true"


def rule_findings_sql(profile: Profile, prepared: Prepared, text: str) -> str:
    """All findings of a catalogue in one text.

    Rules are unrolled so that each regex is a constant (compiled once per task,
    not per row); what follows is shared by all rules. The confidence of a rule
    with required context words halves at every match without one near it and
    stays reduced.
    """
    found = ",\n".join(
        f"CASE WHEN {matches_sql(text, r.pattern, prepared)} THEN struct({i} AS ord, "
        f"{gaps_and_hits(text, r.pattern)} AS cut, {chunks_sql(text)} AS chunks) END"
        for i, r in enumerate(profile.rules))
    meta = f"get({_rule_table(profile)}, r.ord)"
    start, end = "acc.pos + x.gap", "acc.pos + x.gap + length(x.hit)"
    accepted = _accepts(profile)
    state = {"pos": ("0", end)}
    confidence = "acc.confidence"
    if any(r.context_words for r in profile.rules):
        near = window_sql("r.chunks", start, end,
                          REQUIRED_CONTEXT_MARGIN)
        confidence = (f"CASE WHEN size({meta}.words) = 0 THEN acc.confidence "
                      f"WHEN exists({meta}.words, w -> contains(lower({near}), w)) "
                      f"THEN acc.confidence ELSE acc.confidence * 0.5D END")
        state["confidence"] = (
            f"CASE WHEN size({meta}.words) = 0 THEN {meta}.confidence "
            f"ELSE {meta}.confidence END",
            f"CASE WHEN {accepted} THEN {confidence} ELSE acc.confidence END")
    else:
        state["confidence"] = (f"{meta}.confidence", "acc.confidence")
    spans = blocked_fold(
        pairs_sql("r.cut"),
        "struct<start_pos:int,end_pos:int,hit:string,confidence:double>", state,
        f"struct({start} AS start_pos, {end} AS end_pos, x.hit AS hit, "
        f"{confidence} AS confidence)", emit=accepted)
    entity = "lower(s.hit)" if profile.name == "recognizers" else "s.hit"
    built = finding_sql(
        source=str(FROM_RULES), rule_ord="r.ord", type=f"{meta}.type",
        description=f"{meta}.description", confidence="s.confidence",
        start_pos="s.start_pos", end_pos="s.end_pos",
        severity=f"{meta}.severity",
        context=window_sql("r.chunks", "s.start_pos", "s.end_pos",
                           CONTEXT_MARGIN),
        detector=quote(profile.detector), entity_text=entity)
    return f"flatten(transform(array_compact(array({found})), r -> transform({spans}, s -> {built})))"


def exfiltration_sql(text: str) -> str:
    """One finding over the whole text when it talks of taking data out."""
    lowered = f"lower({text})"
    built = finding_sql(
        source=str(FROM_CONTEXT), rule_ord="0", type="'potential_data_exfiltration'",
        description="'Potential data exfiltration attempt detected'", confidence="0.7D",
        start_pos="0", end_pos=f"length({text})", severity=quote(HIGH),
        context=f"substring({text}, 1, 100)", detector="'context_aware'", entity_text="''")
    return (f"CASE WHEN {any_word_sql(lowered, ('export', 'download'))} AND "
            f"{any_word_sql(lowered, ('database', 'users', 'passwords'))} THEN array({built}) "
            f"ELSE cast(array() AS {FINDINGS}) END")


def scan(texts: DataFrame, profile: str | Profile, with_context: bool = False,
         text: str = "text") -> DataFrame:
    """Add ``findings``: every match of every rule, in rule order then position."""
    profile = profile_of(profile)
    prepared = _prepared(profile, text, texts)
    found = rule_findings_sql(profile, prepared, text)
    if with_context:
        found = f"concat({found}, {exfiltration_sql(text)})"
    return prepared.drop(prepared.add(texts).withColumn(
        "findings", F.expr(f"cast({found} AS {FINDINGS})")))


def at_least(scanned: DataFrame, confidence: float) -> DataFrame:
    """Keep the findings of this confidence or more."""
    return scanned.withColumn(
        "findings", F.filter("findings", lambda f: f["confidence"] >= confidence))


def explode_findings(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row per finding. The outer form keeps the optimizer from evaluating
    the scan a second time for a non-empty check."""
    return (scanned.select(*keys, F.explode_outer("findings").alias("f"))
            .where(F.col("f.type").isNotNull()).select(*keys, "f.*"))


def split_texts(scanned: DataFrame, clean: bool, *columns) -> DataFrame:
    """``columns`` of the texts without (``clean``) or with findings.

    A plain filter on ``findings`` would be pushed below the scan and repeat what
    the scan shares between rules; a filter on the first generated row is not.
    """
    first = scanned.select(*columns, F.posexplode_outer("findings.type").alias("_pos", "_type"))
    return first.where(F.col("_pos").isNull() if clean else F.col("_pos") == 0).drop("_pos", "_type")


def register_scan(spark: SparkSession, profile: str | Profile, name: str, with_context: bool = False) -> None:
    """Two SQL functions made of the same expressions as ``scan``. ``name(text)`` gives the array of
    findings and becomes part of the projection: ``SELECT id, name(text) AS found FROM t``, then explode.
    ``name_rows(text)`` is a table function, for ``FROM t, LATERAL name_rows(t.text) f``; Spark runs a
    lateral query once for each different text and joins on it, so large tables take the first form."""
    profile = profile_of(profile)
    prepared = Prepared([r.pattern for r in profile.rules], "given")
    shared = {"text": "given", **prepared.columns()}
    prepared.text, prepared.LOWERED, prepared.FOLDS = "row.text", f"row.{prepared.LOWERED}", f"row.{prepared.FOLDS}"
    prepared.probes = {probe: f"row.{column}" for probe, column in prepared.probes.items()}
    found = rule_findings_sql(profile, prepared, "row.text")
    if with_context:
        found = f"concat({found}, {exfiltration_sql('row.text')})"
    bound = ", ".join(f"{sql} AS {column}" for column, sql in shared.items())  # computed once for all rules
    fields = ", ".join(f.replace(":", " ") for f in FINDING[len("struct<"):-1].split(","))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(given STRING) RETURNS {FINDINGS}
        RETURN get(transform(array(struct({bound})), row -> cast({found} AS {FINDINGS})), 0)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_rows(given STRING) RETURNS TABLE ({fields})
        RETURN SELECT inline(found) FROM (SELECT {name}(given) AS found)""")
