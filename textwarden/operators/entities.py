"""Findings of an external entity analyser, given as a table
``(doc_id, entity_type, score, start_pos, end_pos)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.checks import (any_word_sql, chunks_sql, cut_sql, severity_sql, strip_sql,
                                         window_sql)
from textwarden.functions.spans import quote
from textwarden.operators.policy import decide_names
from textwarden.operators.resolve import survivors
from textwarden.operators.scan import (CONTEXT_MARGIN, FINDING, FINDINGS, FROM_ENTITIES,
                                       explode_findings, finding_sql, profile_of, rule_names, scan)
from textwarden.rules import (DEVELOPMENT_ENTITIES, DEVELOPMENT_KEYWORDS, DEVELOPMENT_SUFFIXES,
                              ENTITY_TYPES_APP, NOT_A_PERSON, PATH_MARKS, Profile)

MIN_PERSON_SCORE = 0.7


def select_types(entities: DataFrame, types) -> DataFrame:
    return entities.where(F.col("entity_type").isin(list(types)))


def is_development_text(text: str) -> str:
    """Does the text speak of files, code or repositories? (SQL)"""
    return any_word_sql(f"lower({text})", DEVELOPMENT_KEYWORDS)


def is_development_entity(entity: str) -> str:
    """Entity texts that mean nothing inside a development text (SQL)."""
    allowed = ", ".join(quote(w) for w in DEVELOPMENT_ENTITIES)
    return (f"({entity} IN ({allowed}) OR {any_word_sql(entity, DEVELOPMENT_SUFFIXES)} "
            f"OR {any_word_sql(entity, PATH_MARKS)})")


def _filtered(profile: Profile) -> bool:
    """``presidio`` also drops likely false positives."""
    return profile.name == "presidio"


def _kept_types(entities: DataFrame, profile: Profile) -> DataFrame:
    chosen = select_types(entities, profile.entity_types)
    if _filtered(profile):
        chosen = chosen.where((F.col("entity_type") != "PERSON") | (F.col("score") >= MIN_PERSON_SCORE))
    return chosen


def _entity_text_sql(chunks: str, start: str, end: str) -> str:
    return strip_sql(f"lower({cut_sql(chunks, start, f'({end} - {start})')})")


def _real_sql(kind: str, entity: str, dev: str) -> str:
    """Whether an entity is no likely false positive (SQL)."""
    not_person = ", ".join(quote(w) for w in NOT_A_PERSON)
    return (f"(length({entity}) > 1 AND NOT ({kind} = 'PERSON' AND {entity} IN ({not_person})) "
            f"AND NOT ({dev} AND {is_development_entity(entity)}))")


def _entity_finding_sql(entity: str, chunks: str, entity_text: str) -> str:
    """The finding of an entity; ``entity`` is a prefix of its fields (SQL)."""
    return finding_sql(
        source=str(FROM_ENTITIES), rule_ord="0", type=f"lower({entity}entity_type)",
        description=f"concat('Presidio detected ', {entity}entity_type)", confidence=f"{entity}score",
        start_pos=f"{entity}start_pos", end_pos=f"{entity}end_pos", severity=severity_sql(f"{entity}score"),
        context=window_sql(chunks, f"{entity}start_pos", f"{entity}end_pos", CONTEXT_MARGIN),
        detector="'presidio'", entity_text=entity_text)


def _external_sql(profile: Profile, text: str = "text", entities: str = "_entities") -> str:
    """Findings of the entities packed in a text's row, in text order (SQL)."""
    entity_text, kept = "''", "true"
    if _filtered(profile):
        entity_text = _entity_text_sql("t.chunks", "e.start_pos", "e.end_pos")
        kept = _real_sql("x.e.entity_type", "x.entity_text", "t.dev")
    dev = is_development_text(text) if _filtered(profile) else "false"
    rows = (f"filter(transform(array_sort({entities}), e -> struct(e AS e, {entity_text} AS entity_text)), "
            f"x -> {kept})")
    found = f"transform({rows}, x -> {_entity_finding_sql('x.e.', 't.chunks', 'x.entity_text')})"
    return (f"CASE WHEN {entities} IS NULL THEN cast(array() AS {FINDINGS}) ELSE cast(flatten(transform("
            f"array(struct({chunks_sql(text)} AS chunks, {dev} AS dev)), t -> {found})) AS {FINDINGS}) END")


def entity_findings(entities: DataFrame, texts: DataFrame, profile: str | Profile = "presidio",
                    key: str = "doc_id") -> DataFrame:
    """Entity rows as findings. ``presidio`` also drops likely false positives.

    One equi-join on the key; what concerns the whole text is computed once per
    text before it, and the text itself does not leave the join.
    """
    profile = profile_of(profile)
    sides = texts.select(key, F.expr(chunks_sql("text")).alias("chunks"), *(
        [F.expr(is_development_text("text")).alias("dev")] if _filtered(profile) else []))
    rows = _kept_types(entities, profile).join(sides, key)
    if _filtered(profile):
        rows = rows.withColumn("entity_text", F.expr(_entity_text_sql("chunks", "start_pos", "end_pos"))).where(
            F.expr(_real_sql("entity_type", "entity_text", "dev")))
    else:
        rows = rows.withColumn("entity_text", F.lit(""))
    found = _entity_finding_sql("", "chunks", "entity_text")
    return rows.select(key, F.expr(f"cast({found} AS {FINDING})").alias("f")).select(key, "f.*")


def entity_labels(entities: DataFrame, types, prefix: str = "") -> DataFrame:
    """``TYPE (confidence: 0.85)`` per entity, optionally with a prefix such as
    ``PII detected: ``; one row per label, position columns kept for ordering."""
    return select_types(entities, types).select(
        "doc_id", "start_pos", "end_pos",
        F.concat(F.lit(prefix), F.format_string("%s (confidence: %.2f)", "entity_type", "score"))
        .alias("label"))


def app_decisions(entities: DataFrame, texts: DataFrame, pii_on: bool = True, secrets_on: bool = True,
                  blocking_on: bool = True, key: str = "doc_id") -> DataFrame:
    """Decision rows whose issues are entity labels, then names of secrets. A
    detector that is off is not part of the plan."""
    none = F.array().cast("array<string>")
    rows = rule_names(texts, "minimal", key) if secrets_on else texts.select(key, none.alias("names"))
    issues = F.transform("names", lambda n: F.concat(F.lit("Secret detected: "), n))
    if pii_on:
        labels = entity_labels(entities, ENTITY_TYPES_APP, "PII detected: ").groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "label"))).alias("labels"))
        rows = rows.join(labels, key, "left")
        issues = F.concat(F.coalesce("labels.label", none), issues)
    return decide_names(rows.select(key, issues.alias("names")), "cloud", blocking_on)


def merged(entities: DataFrame, texts: DataFrame, profile: str | Profile = "presidio",
           key: str = "doc_id") -> DataFrame:
    """Texts with ``findings`` of entities and rules together, overlaps resolved. On equal
    starts the order is external entities, then rules.

    The entities of a text are packed into one row, equal ones once, and meet it in one join; the
    text is scanned after it, and everything else happens in its row: one shuffle of the entities,
    one of the texts, nothing stored. The fold over a long list works in blocks.
    """
    profile = profile_of(profile)
    own = "_entities"
    while own in texts.columns:
        own = f"_{own}"
    packed = _kept_types(entities, profile).groupBy(key).agg(F.collect_set(F.struct(
        "start_pos", "end_pos", F.lower("entity_type").alias("type"), "entity_type", "score")).alias(own))
    found = scan(texts.join(packed, key, "left"), profile)
    both = f"concat({_external_sql(profile, entities=own)}, findings)"
    return found.withColumn("findings", F.expr(survivors(both))).drop(own)


def merged_findings(entities: DataFrame, texts: DataFrame, profile: str | Profile = "presidio",
                    key: str = "doc_id") -> DataFrame:
    """``merged``, one row per finding."""
    return explode_findings(merged(entities, texts.select(key, "text"), profile, key), key)
