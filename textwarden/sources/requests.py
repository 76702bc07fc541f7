"""Chat requests as JSON text: parsing, validation, text extraction.

A request table has a key and a JSON column ``body``. Nothing here fails a job:
bad rows get a ``status`` and an ``error`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults and ranges of a request.
DEFAULT_MODEL = "deepseek-chat"
DEFAULT_TEMPERATURE, TEMPERATURE_RANGE = 0.7, (0.0, 2.0)
DEFAULT_MAX_TOKENS, MAX_TOKENS_RANGE = 1000, (1, 4000)
DEFAULT_TOP_P, TOP_P_RANGE = 1.0, (0.0, 1.0)

INVALID_JSON = "Invalid JSON"
NO_MESSAGES = "No messages provided"

_MESSAGES = "try_variant_get(request, '$.messages', 'array<variant>')"
_CONTENT = "try_variant_get(m, '$.content', 'variant')"


def parse_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``request`` (variant, null when the body is no JSON), ``status`` and
    ``error``. Anything but an object cannot be served and is an internal error."""
    parsed = requests.withColumn("request", F.try_parse_json(body))
    is_object = F.schema_of_variant("request").startswith("OBJECT")
    return parsed.withColumn(
        "status", F.when(F.col("request").isNull(), 400).when(~is_object, 500).otherwise(200)
    ).withColumn("error", F.when(F.col("status") == 400, INVALID_JSON)
                 .when(F.col("status") == 500, "Internal error"))


def valid_requests(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == 200)


def quarantined(parsed: DataFrame) -> DataFrame:
    """Requests that could not be parsed, kept for inspection."""
    return parsed.where(F.col("status") != 200)


def with_defaults(parsed: DataFrame) -> DataFrame:
    """Typed request fields, defaults filled in."""
    return parsed.select(
        "*",
        F.expr(f"coalesce(try_variant_get(request, '$.model', 'string'), '{DEFAULT_MODEL}')")
        .alias("model"),
        F.expr(f"coalesce(size({_MESSAGES}), 0)").cast("long").alias("n_messages"),
        F.expr("coalesce(try_variant_get(request, '$.temperature', 'double'), "
               f"{DEFAULT_TEMPERATURE}D)").alias("temperature"),
        F.expr("coalesce(try_variant_get(request, '$.max_tokens', 'bigint'), "
               f"{DEFAULT_MAX_TOKENS}L)").alias("max_tokens"),
        F.expr(f"coalesce(try_variant_get(request, '$.top_p', 'double'), {DEFAULT_TOP_P}D)")
        .alias("top_p"),
        F.expr("coalesce(try_variant_get(request, '$.stream', 'boolean'), false)").alias("stream"))


def _wrong_type(field: str, kind: str) -> Column:
    """Whether a field holds what the strict schema cannot take as ``kind``. Text
    that spells a number or a truth value is taken, and so is null (not for text)."""
    found = f"schema_of_variant(try_variant_get(request, '$.{field}', 'variant'))"
    text = f"try_variant_get(request, '$.{field}', 'string')"
    number, simple = f"try_cast({text} AS double)", f"{found} IN ('VOID', 'BOOLEAN')"
    good = {"text": f"{found} = 'STRING'",
            "number": f"({simple} OR {number} IS NOT NULL)",
            "integer": f"({simple} OR {number} = floor({number}))",
            "truth": f"({simple} OR lower({text}) IN "
                     "('1', '0', 'true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', 'on', 'off'))"}[kind]
    return F.expr(f"{found} IS NOT NULL AND NOT coalesce({good}, false)")


def validate(parsed: DataFrame) -> DataFrame:
    """The strict schema: ``reject_reason`` lists every field that violates it."""
    def outside(column, limits):
        return ~F.col(column).between(*limits)

    rows = with_defaults(parsed)
    no_list = F.expr(f"{_MESSAGES} IS NULL")
    bad_message = F.expr(
        f"exists(coalesce({_MESSAGES}, array()), m -> "
        f"NOT coalesce(schema_of_variant(try_variant_get(m, '$.role', 'variant')) = 'STRING', false) "
        f"OR NOT coalesce(schema_of_variant({_CONTENT}) = 'STRING', false))")
    return rows.withColumn("reject_reason", F.array_compact(F.array(
        F.when(F.col("status") != 200, F.col("error")),
        F.when((F.col("status") == 200) & no_list, "messages"),
        F.when((F.col("status") == 200) & bad_message, "message"),
        F.when(_wrong_type("model", "text"), "model"),
        F.when(_wrong_type("temperature", "number") | outside("temperature", TEMPERATURE_RANGE),
               "temperature"),
        F.when(_wrong_type("max_tokens", "integer") | outside("max_tokens", MAX_TOKENS_RANGE),
               "max_tokens"),
        F.when(_wrong_type("top_p", "number") | outside("top_p", TOP_P_RANGE), "top_p"),
        F.when(_wrong_type("stream", "truth"), "stream"))))


def reject_empty(parsed: DataFrame) -> DataFrame:
    """Requests without messages get 400 before anything is scanned."""
    empty = (F.col("status") == 200) & F.expr(f"coalesce(size({_MESSAGES}), 0) = 0")
    return (parsed.withColumn("error", F.when(empty, NO_MESSAGES).otherwise(F.col("error")))
            .withColumn("status", F.when(empty, 400).otherwise(F.col("status"))))


def _as_text(value: str) -> str:
    """Text of a JSON value that is neither a string nor a list."""
    return f"""CASE schema_of_variant({value}) WHEN 'VOID' THEN 'None'
        WHEN 'BOOLEAN' THEN initcap(cast({value} AS string))
        ELSE coalesce(try_cast({value} AS string), to_json({value})) END"""


#: The content of each message and its kind, read once for all uses.
_CONTENTS = (f"transform(transform(coalesce({_MESSAGES}, array()), m -> {_CONTENT}), "
             "c -> struct(c AS value, schema_of_variant(c) AS kind))")


def flattened_text(separator: str = " ") -> Column:
    """Text of all messages of ``request`` where content may be a string, a list
    of parts (objects with ``text`` and strings count), or any other value."""
    sep = f"'{separator}'"
    part = f"""CASE WHEN schema_of_variant(p) = 'STRING' THEN cast(p AS string) || {sep}
        WHEN schema_of_variant(p) LIKE 'OBJECT%'
        THEN coalesce(try_variant_get(p, '$.text', 'string') || {sep}, '') ELSE '' END"""
    return F.expr(f"""array_join(transform({_CONTENTS}, x -> CASE
        WHEN x.value IS NULL THEN {sep}
        WHEN x.kind = 'STRING' THEN cast(x.value AS string) || {sep}
        WHEN x.kind LIKE 'ARRAY%' THEN array_join(transform(cast(x.value AS array<variant>), p -> {part}), '')
        ELSE {_as_text("x.value")} || {sep} END), '')""")


def plain_text(separator: str = " ") -> Column:
    """Text of all messages where only string content (or none) is understood;
    null when a message holds anything else."""
    sep = "'\\n'" if separator == "\n" else f"'{separator}'"
    return F.expr(f"""get(transform(array({_CONTENTS}), all -> CASE
        WHEN NOT exists(all, x -> x.value IS NOT NULL AND x.kind <> 'STRING')
        THEN array_join(transform(all, x -> coalesce(cast(x.value AS string), '') || {sep}), '') END), 0)""")


def request_texts(parsed: DataFrame, multimodal: bool = False, separator: str = " ") -> DataFrame:
    """Add ``text``. Requests whose content is not understood become error rows
    (status 500) instead of failing the job; ``quarantined`` keeps them."""
    text = flattened_text(separator) if multimodal else plain_text(separator)
    rows = parsed.withColumn("text", F.when(F.col("status") == 200, text))
    bad = (F.col("status") == 200) & F.col("text").isNull()
    return (rows.withColumn("error", F.when(bad, "Internal error").otherwise(F.col("error")))
            .withColumn("status", F.when(bad, 500).otherwise(F.col("status"))))
