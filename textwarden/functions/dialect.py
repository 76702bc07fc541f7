"""Write a Python regex so that the JVM finds the same matches.

Differences that matter for text: Python's ``\\s`` also takes U+001C..U+001F,
its word characters are exactly letters, numbers and ``_`` (the JVM adds marks
and connectors), and ignoring case reaches beyond ASCII.
"""

from __future__ import annotations

# The letter U+10000 makes lookbehinds step over whole characters, not half ones.
_WORD = r"\p{L}\p{N}_" + "\U00010000"
_OUTSIDE = {
    "s": r"[\s\x1c-\x1f]",
    "w": f"[{_WORD}]",
    "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
}
# Where a text has none of these, the JVM's own word boundary is the same and
# several times faster: marks, connectors, joiners, numbers that are no digits,
# and symbols that count as alphabetic.
RARE_WORD_CHARACTERS = (
    r"(?U)[\p{M}\p{No}\x{200c}\x{200d}[\p{Pc}&&[^_]][\p{IsAlphabetic}&&[^\p{L}\p{N}]]]")
_INSIDE = {"s": r"\s\x1c-\x1f", "w": _WORD}


def jvm_regex(regex: str, ignore_case: bool = True, first: str = "",
              plain_boundary: bool = False) -> str:
    """The same pattern for ``rlike`` / ``regexp_extract_all`` / ``split``.

    ``first`` is a class every match starts with; it is tested before all else.
    ``plain_boundary``: for texts without ``RARE_WORD_CHARACTERS``.
    """
    outside = {**_OUTSIDE, "b": r"\b"} if plain_boundary else _OUTSIDE
    out, in_class, chars = [], False, iter(f"(?={first})(?:{regex})" if first else regex)
    for ch in chars:
        if ch == "\\":
            nxt = next(chars)
            table = _INSIDE if in_class else outside
            out.append(table.get(nxt, "\\" + nxt))
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif in_class and ch in "[&":     # plain characters in Python, operators in the JVM
            ch = "\\" + ch
        out.append(ch)
    body = "".join(out)
    if not ignore_case:
        return "(?U)" + body
    # An upper-case range alone misses letters whose lower case is ASCII (Kelvin sign).
    return "(?iU)" + body.replace("A-Za-z", "a-z").replace("A-Z", "A-Za-z")
