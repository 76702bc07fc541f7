"""Secrets: known shapes, and strings of high entropy.

Three base kinds are found by pattern, leftmost and without overlap per kind. Beside them,
candidate strings with letters and digits are read through a sliding window; the counts of its
characters are kept up to date as it moves, and with them its Shannon entropy. Each character
class has its own threshold. The part of a candidate from the first to the last window above it
is a span, unless the candidate is on the allow-list or a base span covers that part.

Null texts count as empty; a text without secrets has empty lists. Each input row gives one
row, so repeated rows and ids repeat. An empty table gives an empty result. Further columns stay
behind (`mask` keeps them). Texts are taken whole. All work is one projection of DataFrame
expressions, without a shuffle. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.spans import blocked_fold, quote
from textwarden.llm.common import documents

# The kinds in their order, their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Of runs that are matched greedily only long ones count, so the length may stand in the pattern.
_SEARCH = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}
#: Cheap tests that all texts with a match pass.
_GATE = {
    "assign": "(contains(text, ':') OR contains(text, '=')) AND rlike(text, "
              + quote(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""") + ")",
    "access": "contains(text, 'AKIA')",
    "hex": "rlike(text, '[0-9a-f]{24}')",
}

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A candidate has letters and digits, so somewhere they meet.
_MIXED = r"[A-Za-z+/_=-][0-9]|[0-9][A-Za-z+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits per character that a window needs, by character class.
THRESHOLDS = {"hex": 2.8, "mixed": 3.7}
#: Candidates that look random but are no secrets: placeholders, counting strings, UUIDs, paths and dates.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|your[_-]|dummy|xxxx",
    r"(?i)0123456789|123456789|abcdefghij",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^/?[a-z]+(?:[/_-][a-z0-9]{1,12})+$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
)
_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
KINDS = (*LEAST, "entropy")


def _positions(regex: str, gate: str, item: str, emit: str) -> str:
    """Spans of a pattern in `text`; `item` and `emit` may use `acc.pos`, `x.gap` and `x.hit`."""
    pairs = ("filter(zip_with(cut.gaps, cut.hits, (g, h) -> struct(length(g) AS gap, h AS hit)), p -> p.hit IS NOT NULL)")
    fold = blocked_fold(pairs, _SPAN, {"pos": ("0", "acc.pos + x.gap + length(x.hit)")}, item, emit)
    cut = f"struct(split(text, {quote(regex)}, -1) AS gaps, regexp_extract_all(text, {quote(regex)}, 0) AS hits)"
    return (f"CASE WHEN {gate} THEN flatten(transform(array({cut}), cut -> {fold})) "
            f"ELSE cast(array() AS array<{_SPAN}>) END")


def base_spans(kind: str) -> Column:
    rank = list(LEAST).index(kind)
    item = (f"struct(acc.pos + x.gap AS start, {rank} AS rank, acc.pos + x.gap + length(x.hit) AS end, "
            f"{quote(kind)} AS kind)")
    emit = f"length(regexp_extract(x.hit, {quote(ASSIGN)}, 2)) >= {LEAST[kind]}" if kind == "assign" else f"length(x.hit) >= {LEAST[kind]}"
    return F.expr(_positions(_SEARCH[kind], _GATE[kind], item, emit))


def _hot(candidate: str) -> str:
    """struct<first, last>: the first and last window of `candidate` above its threshold (null: none)."""
    gain = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0}D" for n in range(WINDOW + 2)) + ")"
    least = (f"CASE WHEN rlike({candidate}, '^[0-9a-fA-F]+$') THEN {THRESHOLDS['hex']}D ELSE {THRESHOLDS['mixed']}D END")
    # counts[c]: how often a character is in the window; total: the sum of n log2 n over them
    enter, leave = "z.enter", "z.leave"
    after_in = f"transform(acc.counts, (n, i) -> CASE WHEN i + 1 = {enter} THEN n + 1 ELSE n END)"
    step = (f"CASE WHEN {leave} IS NULL THEN acc.counts ELSE "
            f"transform(acc.counts, (n, i) -> CASE WHEN i + 1 = {leave} THEN n - 1 ELSE n END) END")
    less = (f"CASE WHEN {leave} IS NULL THEN 0D ELSE element_at({gain}, element_at(acc.counts, {leave})) "
            f"- element_at({gain}, element_at(acc.counts, {leave}) + 1) END")
    more = f"element_at({gain}, element_at(acc.counts, {enter}) + 2) - element_at({gain}, element_at(acc.counts, {enter}) + 1)"
    codes = (f"transform(split({candidate}, ''), (c, i) -> struct(i AS at, locate(c, {quote(ALPHABET)}) AS enter))")
    steps = (f"transform(codes, (c, i) -> struct(c.at AS at, c.enter AS enter, "
             f"CASE WHEN i >= {WINDOW} THEN element_at(codes, i + 1 - {WINDOW}).enter END AS leave))")
    left = f"struct({step} AS counts, acc.total + {less} AS total, acc.first AS first, acc.last AS last)"
    joined = f"struct({after_in} AS counts, acc.total + {more} AS total, acc.first AS first, acc.last AS last)"
    hot = f"(z.at + 1 >= {WINDOW} AND {math.log2(WINDOW)}D - acc.total / {WINDOW} >= {least})"
    marked = (f"struct(acc.counts AS counts, acc.total AS total, "
              f"CASE WHEN {hot} THEN coalesce(acc.first, z.at + 1 - {WINDOW}) ELSE acc.first END AS first, "
              f"CASE WHEN {hot} THEN z.at + 1 ELSE acc.last END AS last)")
    one = lambda value, body: f"element_at(transform(array({value}), acc -> {body}), 1)"
    body = one(one(left, joined), marked)
    init = (f"struct(array_repeat(0, {len(ALPHABET)}) AS counts, 0D AS total, cast(NULL AS int) AS first, cast(NULL AS int) AS last)")
    folded = f"aggregate({steps}, {init}, (acc, z) -> {body}, acc -> struct(acc.first AS first, acc.last AS last))"
    return f"element_at(transform(array({codes}), codes -> {folded}), 1)"


def entropy_spans(allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of high entropy, whether base spans cover them or not."""
    good = " AND ".join([f"rlike(x.hit, {quote(_MIXED)})", "rlike(x.hit, '[A-Za-z]')",
                         *(f"NOT rlike(x.hit, {quote(a)})" for a in allow)])
    item = "struct(acc.pos + x.gap AS start, 0 AS rank, acc.pos + x.gap + length(x.hit) AS end, x.hit AS kind)"
    found = _positions(CANDIDATE, f"rlike(text, {quote(_MIXED)})", item, good)
    spans = (f"transform(filter(transform({found}, c -> struct(c.start AS start, {_hot('c.kind')} AS hot)), s -> s.hot.first IS NOT NULL), "
             f"s -> struct(s.start + s.hot.first AS start, {len(LEAST)} AS rank, s.start + s.hot.last AS end, 'entropy' AS kind))")
    return F.expr(spans)


def find(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """`docs` with `assign`, `access`, `hex` (lists of spans) and `found` (all spans in order)."""
    marked = docs.withColumns({kind: base_spans(kind) for kind in LEAST}).withColumn("_entropy", entropy_spans(allow))
    base = F.concat(*LEAST)
    fresh = F.filter("_entropy", lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    return marked.withColumn("found", F.array_sort(F.concat(base, fresh))).drop("_entropy")


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, and all spans."""
    found = find(documents(docs), allow)
    base = F.array_sort(F.concat(*LEAST))
    return found.select("doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in LEAST),
                        F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"))


def mask(docs: DataFrame, by: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """`docs` with every span in `text` (overlapping ones as one) replaced; null texts stay null."""
    names = docs.columns
    hidden = {n: f"_kept_{i}" for i, n in enumerate(names) if n != "text"}
    found = find(docs.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{n}`").alias(h) for n, h in hidden.items())), allow)
    step = ("struct(CASE WHEN s.end <= acc.pos THEN acc.parts WHEN s.start < acc.pos THEN acc.parts "
            f"ELSE concat(acc.parts, array(substring(text, acc.pos + 1, s.start - acc.pos), {quote(by)})) END AS parts, "
            "greatest(acc.pos, s.end) AS pos)")
    masked = ("aggregate(found, struct(cast(array() AS array<string>) AS parts, 0 AS pos), "
              f"(acc, s) -> {step}, acc -> array_join(concat(acc.parts, array(substring(text, acc.pos + 1))), ''))")
    text = F.expr(f"CASE WHEN text IS NULL THEN NULL WHEN size(found) = 0 THEN text ELSE {masked} END")
    return found.select(*(text.alias("text") if n == "text" else F.col(hidden[n]).alias(n) for n in names))
