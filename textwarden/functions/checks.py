"""Scalar checks on matched texts and on whole texts. The ``*_sql`` forms serve
inside higher-order functions, the others take and return columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden.functions.spans import quote
from textwarden.rules import CRITICAL, HIGH, LOW, MEDIUM, SEVERITY_FLOOR

# Python's str.isspace set, for the JVM (Unicode white space plus U+001C..U+001F).
WHITE = r"[\s\x1c-\x1f]"

# Every decimal digit beyond ASCII with its value: runs of ten, in order.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def strip_sql(text: str) -> str:
    """Trim all white space on both ends, not just blanks."""
    return f"regexp_replace({text}, {quote(f'(?U)^{WHITE}+|{WHITE}+$')}, '')"


def tokens(text: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.size(F.filter(F.split(text, rf"(?U){WHITE}+"), lambda x: x != ""))


def luhn_sql(number: str) -> str:
    """Digits with optional blanks and dashes, at least 13, checksum mod 10."""
    plain = f"regexp_replace({number}, {quote(f'(?U)-|{WHITE}')}, '')"
    digits = f"translate({plain}, '{_DIGITS}', '{_VALUES}')"
    weighted = (f"transform(split(reverse({digits}), ''), (d, i) -> "
                "CASE WHEN i % 2 = 0 THEN try_cast(d AS int) "
                "ELSE (try_cast(d AS int) * 2 - 1) % 9 + 1 END)")
    return (f"(CASE WHEN rlike({digits}, '^[0-9]{{13,}}$') THEN "
            f"aggregate({weighted}, 0, (s, v) -> s + coalesce(v, 0)) % 10 = 0 ELSE false END)")


def email_shape_sql(address: str) -> str:
    """Exactly one ``@``, something on both sides, a dot in the domain."""
    parts = f"split({address}, '@', -1)"
    return (f"(size({parts}) = 2 AND get({parts}, 0) <> '' "
            f"AND contains(get({parts}, 1), '.'))")


def severity_sql(confidence: str) -> str:
    """Severity class of a confidence."""
    cases = " ".join(f"WHEN {confidence} >= {SEVERITY_FLOOR[s]}D THEN '{s}'"
                     for s in (CRITICAL, HIGH, MEDIUM))
    return f"(CASE {cases} ELSE '{LOW}' END)"


# Taking characters out of a string walks it from its start. Texts are therefore
# cut into chunks of this many characters once, and cut-outs touch only theirs.
CHUNK = 4096


def chunks_sql(text: str) -> str:
    """The text as array<string> of chunks."""
    return (f"CASE WHEN length({text}) <= {CHUNK} THEN array({text}) "
            f"ELSE regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0) END")


def cut_sql(chunks: str, start: str, length: str) -> str:
    """``length`` characters from 0-based ``start``, as far as there are any."""
    return (f"substring(array_join(slice({chunks}, int({start} div {CHUNK}) + 1, "
            f"int({length} div {CHUNK}) + 2), ''), int({start} % {CHUNK}) + 1, int({length}))")


def window_sql(chunks: str, start: str, end: str, margin: int) -> str:
    """The text from ``start - margin`` to ``end + margin``, cut at the edges."""
    begin = f"greatest({start} - {margin}, 0)"
    return cut_sql(chunks, begin, f"({end} + {margin} - {begin})")


def shorten_sql(text: str, size: int) -> str:
    """The first ``size`` characters, with an ellipsis when something was cut."""
    return (f"(CASE WHEN length({text}) > {size} THEN concat(substring({text}, 1, {size}), '...') "
            f"ELSE {text} END)")


def any_word_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


VALIDATORS = {"luhn": luhn_sql, "email": email_shape_sql}
