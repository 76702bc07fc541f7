"""Match positions and blocked folds, as Spark SQL expressions.

Expressions are written as SQL text: a catalogue of rules becomes one parsed
expression instead of hundreds of driver calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.dialect import RARE_WORD_CHARACTERS, jvm_regex
from textwarden.rules import Pattern

# Folds append to arrays; appending copies, so items are first put into a block
# of this size and whole blocks are appended. That keeps a text with a million
# matches close to linear.
BLOCK = 512


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_regex(text: str, pattern: Pattern, call: str) -> str:
    """SQL of ``call`` with ``{regex}`` filled in; texts without rare characters
    get the cheaper word boundary. Both regexes stay constants."""
    def filled(plain: bool) -> str:
        return call.replace("{regex}", quote(jvm_regex(
            pattern.regex, pattern.ignore_case, pattern.first, plain)))

    if "\\b" not in pattern.regex:
        return filled(False)
    return (f"CASE WHEN rlike({text}, {quote(RARE_WORD_CHARACTERS)}) THEN {filled(False)} "
            f"ELSE {filled(True)} END")


def gaps_and_hits(text: str, pattern: Pattern) -> str:
    """struct<gaps, hits>: the matches and the text between them."""
    return with_regex(text, pattern, f"struct(split({text}, {{regex}}, -1) AS gaps, "
                                     f"regexp_extract_all({text}, {{regex}}, 0) AS hits)")


def blocked_fold(items: str, element: str, state: dict[str, tuple[str, str]], item: str,
                 emit: str = "true", last: str | None = None) -> str:
    """SQL of a left-to-right fold that returns an array<``element``>.

    ``state`` maps a variable to (initial value, next value); next values,
    ``item`` and ``emit`` may use the lambda variables ``acc`` (state) and ``x``
    (current input). ``item`` is appended where ``emit`` holds; ``last``, on the
    final ``acc``, is appended when it is not null.
    """
    room = f"size(acc.open) < {BLOCK}"
    init = ", ".join(f"{v} AS {k}" for k, (v, _) in state.items())
    step = ", ".join(f"{v} AS {k}" for k, (_, v) in state.items())
    tail = f", filter(array({last}), z -> z IS NOT NULL)" if last else ""
    return f"""aggregate({items},
        struct({init}, cast(array() AS array<{element}>) AS open,
               cast(array() AS array<array<{element}>>) AS blocks),
        (acc, x) -> struct({step},
            CASE WHEN NOT ({emit}) THEN acc.open
                 WHEN {room} THEN concat(acc.open, array({item}))
                 ELSE array({item}) END AS open,
            CASE WHEN NOT ({emit}) OR {room} THEN acc.blocks
                 ELSE concat(acc.blocks, array(acc.open)) END AS blocks),
        acc -> concat(flatten(acc.blocks), acc.open{tail}))"""


# Letters outside ASCII that equal an ASCII letter when case is ignored and that
# lower() leaves alone.
_FOLDING = ("\u017f", "\u0131", "\u0130")


class Prepared:
    """Columns computed once per text and shared by the tests of all patterns."""

    def __init__(self, patterns, text: str = "text", taken=()):
        """``taken`` are the columns of the texts; the new ones get other names."""
        self.text = text
        mark = "_"
        while any(c.lower().startswith((f"{mark}lowered", f"{mark}folds", f"{mark}probe")) for c in taken):
            mark += "_"
        self.LOWERED, self.FOLDS = f"{mark}lowered", f"{mark}folds"
        used = [p.probe for p in patterns if p.probe]
        self.probes = {p: f"{mark}probe{i}" for i, p in enumerate(
            sorted(p for p in set(used) if used.count(p) > 1))}

    def columns(self) -> dict[str, str]:
        """The shared columns as SQL."""
        folds = " OR ".join(f"contains({self.text}, {quote(c)})" for c in _FOLDING)
        return {self.LOWERED: f"lower({self.text})", self.FOLDS: f"({folds})",
                **{name: self._probe(probe) for probe, name in self.probes.items()}}

    def add(self, texts: DataFrame) -> DataFrame:
        return texts.withColumns({name: F.expr(sql) for name, sql in self.columns().items()})

    def _probe(self, probe: str) -> str:
        return f"rlike({self.text}, {quote(jvm_regex(probe))})"

    def probe(self, probe: str) -> str:
        """The column of a shared probe, or the probe itself."""
        return self.probes.get(probe) or self._probe(probe)

    def drop(self, texts: DataFrame) -> DataFrame:
        return texts.drop(self.LOWERED, self.FOLDS, *self.probes.values())


def _contains_all(text: str, entries) -> list[str]:
    return ["(" + " OR ".join(f"contains({text}, {quote(lit)})" for lit in alternatives) + ")"
            for alternatives in entries]


def matches_sql(text: str, pattern: Pattern, prepared: Prepared | None = None) -> str:
    """Does the pattern occur? Cheap tests first; the regex stops at the first
    occurrence."""
    tests = _contains_all(text, pattern.needs)
    if prepared and pattern.words:
        words = " AND ".join(_contains_all(prepared.LOWERED, pattern.words))
        tests.append(f"({prepared.FOLDS} OR ({words}))")
    if prepared and pattern.probe:
        tests.append(prepared.probe(pattern.probe))
    tests.append(f"({with_regex(text, pattern, f'rlike({text}, {{regex}})')})")
    return "(" + " AND ".join(tests) + ")"


def is_match(text: str, pattern: Pattern) -> Column:
    return F.expr(matches_sql(text, pattern))


def pairs_sql(cut: str) -> str:
    """Matches of ``gaps_and_hits`` with the length of the gap before each; running
    sums of both lengths give code-point offsets (0-based, end-exclusive)."""
    return (f"filter(zip_with({cut}.gaps, {cut}.hits, (g, h) -> struct(length(g) AS gap, h AS hit)), "
            f"p -> p.hit IS NOT NULL)")


def match_spans_sql(text: str, pattern: Pattern) -> str:
    """All non-overlapping matches, left to right, as
    array<struct<start_pos, end_pos, hit>>."""
    end = "acc.pos + x.gap + length(x.hit)"
    element = "struct<start_pos:int,end_pos:int,hit:string>"
    spans = blocked_fold(
        pairs_sql("cut"), element, {"pos": ("0", end)},
        f"struct(acc.pos + x.gap AS start_pos, {end} AS end_pos, x.hit AS hit)")
    return (f"CASE WHEN {matches_sql(text, pattern)} THEN "
            f"flatten(transform(array({gaps_and_hits(text, pattern)}), cut -> {spans})) "
            f"ELSE cast(array() AS array<{element}>) END")


def match_spans(text: str, pattern: Pattern) -> Column:
    return F.expr(match_spans_sql(text, pattern))
