"""Chat logs as events: fold them into final messages, render those, and read the result back.

Events of a conversation are taken in the order of `seq` (then kind, role and text). `message`
opens the next message; `delta` adds text to a message; `edit` replaces its text; `regenerate`
empties it for the deltas that follow. An event without `target` means the message opened last,
with it the message of that number (from 1). A delta before any message opens message 0.

A template marks turns; control characters inside roles and texts are escaped, reversibly, so
that no text can form a mark. The loss mask covers the text of each assistant turn.

Null texts and roles count as empty; a null conversation id is a conversation. Repeated events
count as often as they come. Empty texts are turns too. An empty table gives an empty result.
Further columns stay behind. Texts are taken whole. All work is DataFrame expressions. Only the
rendered conversation, which is the result, gathers a conversation in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column, line: bool = False) -> Column:
    """`text` without `<` (and without line ends); every `\\` begins an escape."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """`conv_id`, `at` (number of the message), `role`, `text` of the final messages.

    `events`: `conv_id`, `seq`, `kind`, `target`, `role`, `text`.
    """
    clean = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "target",
                          F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq").asc_nulls_first(), "kind", "role", "text"]
    whole = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = clean.select(
        "*", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("n"),
        F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(whole).alias("opened"))
    aimed = numbered.withColumn("at", F.coalesce(F.when(F.col("kind") != "message", F.col("target")), "opened").cast("long"))
    reset = F.max(F.when(F.col("kind") != "delta", F.col("n"))).over(Window.partitionBy("conv_id", "at"))
    live = aimed.withColumn("reset", F.coalesce(reset, F.lit(0)))
    parts = F.sort_array(F.collect_list(F.when(F.col("n") >= F.col("reset"), F.struct("n", "text"))))
    return (live.groupBy("conv_id", "at")
            .agg(F.min_by("role", F.struct(F.col("kind") != "message", "n")).alias("role"), parts.alias("parts"))
            .select("conv_id", "at", "role", F.array_join("parts.text", "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """`conv_id`, `formatted`, `loss` (spans of code points under the loss mask) of each conversation."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), line=True), F.lit("\n"))
    turns = messages.select("conv_id", "at", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    placed = turns.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.char_length("head"))
    span = F.struct("start", (F.col("start") + F.char_length("body")).alias("end"))
    return (placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"))
        .select("conv_id", F.array_join("turns.turn", "").alias("formatted"), "loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """`conv_id`, `n_turns`, digests and counts, all from `formatted` and `loss` alone."""
    parts = (formatted.select("conv_id", F.posexplode(F.split("formatted", CLOSE, -1)).alias("i", "part"),
                              F.lit(0).alias("span"))
             .where("part <> ''"))
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = (F.char_length("part") + len(CLOSE)).cast("long")
    placed = parts.select("conv_id", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start"), "part", "span",
                          F.lit(None).cast("long").alias("length"))
    spans = (formatted.select("conv_id", F.explode("loss").alias("x"))
             .select("conv_id", "x.start", F.lit(None).cast("string").alias("part"), F.lit(1).alias("span"),
                     (F.col("x.end") - F.col("x.start")).alias("length")))
    # a span lies in the turn that starts last before it
    order = Window.partitionBy("conv_id").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.struct(F.last("part", True).over(order).alias("part"),
                    F.last(F.when(F.col("span") == 0, F.col("start")), True).over(order).alias("start"))
    seen = placed.unionByName(spans).withColumn("turn", turn)
    inside = F.substring("turn.part", (F.col("start") - F.col("turn.start") + 1).cast("int"), F.col("length").cast("int"))
    cut = F.instr("part", "\n")
    role = unescape(F.substring("part", F.lit(len(OPEN) + 1), cut - len(OPEN) - 1))
    text = unescape(F.substring("part", cut + 1, F.char_length("part")))
    rows = seen.select("conv_id", "span", "start", F.when(F.col("span") == 1, unescape(inside)).alias("masked"),
                       F.when(F.col("span") == 0, F.concat(role, F.lit("\n"), text, F.lit("\n"))).alias("said"),
                       F.when(F.col("span") == 0, size).alias("size"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("start", c))))[c], "")
    return rows.groupBy("conv_id").agg(
        F.count("said").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.coalesce(F.sum(F.char_length("masked").cast("long")), F.lit(0)).alias("loss_chars"),
        F.sha2(joined("masked"), 256).alias("loss_sha256"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("formatted_chars"))


def turn_events(conversations: DataFrame) -> DataFrame:
    """The rows of a table of turns as the events that a log would hold of them.

    An assistant's turn is streamed in deltas, after a first answer that is regenerated; any other turn is
    sent unfinished and then edited. Rows are taken by turn, role and text, and null turns first; equal
    rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("place"), role.alias("role"), text.alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))

    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), said.alias("text"))

    streamed = [event("message", F.lit("")), event("delta", rest), event("regenerate", F.lit("")), event("delta", first), event("delta", rest)]
    sent = [event("message", first), event("edit", F.col("text"))]
    events = F.when(F.col("role") == "assistant", F.array(*streamed)).otherwise(F.array(*sent))
    return (rows.select("conv_id", "place", "role", F.posexplode(events).alias("step", "event"))
            .select("conv_id", (F.col("place") * len(streamed) + F.col("step")).alias("seq"), "event.kind",
                    F.lit(None).cast("long").alias("target"), "role", "event.text"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like marks of templates."""
    said = r"\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(said).alias("text"))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe(conversations.sparkSession))
    return read_back(render(fold(turn_events(rows))))


ORACLE_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(sum(15 + length(role) + length(text) + 2 * length(role) + 2 * length(text)
                - length(replace(role, '\', '')) - length(replace(role, '<', '')) + length(role)
                - length(replace(role, chr(10), ''))
                - length(replace(text, '\', '')) - length(replace(text, '<', '')) ) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
