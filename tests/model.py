"""A small model of the detection semantics on Python's ``re``, for comparison."""

import re

from textwarden.rules import HARMLESS_WORDS, PROFILES


def luhn(number):
    digits = [int(c) for c in re.sub(r"[-\s]", "", number)]
    if len(digits) < 13:
        return False
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10))
               for i, d in enumerate(reversed(digits))) % 10 == 0


def matches(pattern, text):
    return re.finditer(pattern.regex, text, re.I if pattern.ignore_case else 0)


def present(profile, text):
    return [r.name for r in PROFILES[profile].rules if next(matches(r.pattern, text), None)]


def scan(profile, text):
    """(type, start, end, confidence, severity, context) in rule order."""
    found = []
    for rule in PROFILES[profile].rules:
        confidence = rule.confidence
        for m in matches(rule.pattern, text):
            if rule.validator == "luhn" and not luhn(m.group()):
                continue
            if rule.context_words:
                near = text[max(0, m.start() - 50):m.end() + 50].lower()
                if not any(w in near for w in rule.context_words):
                    confidence *= 0.5
            found.append((rule.name, m.start(), m.end(), confidence, rule.severity,
                          text[max(0, m.start() - 20):m.end() + 20]))
    return found


def overlap(a, b):
    return a[1] < b[2] and b[1] < a[2]


def dedupe(found):
    """The definition, with all survivors compared."""
    kept = []
    for f in sorted(found, key=lambda f: f[1]):
        clash = next((k for k in kept if overlap(f, k)), None)
        if clash is None:
            kept.append(f)
        elif f[3] > clash[3]:
            kept.remove(clash)
            kept.append(f)
    return kept


def findings(profile, text):
    found = scan(profile, text)
    if PROFILES[profile].dedupe:
        found = dedupe(found)
    if PROFILES[profile].rank:
        found.sort(key=lambda f: -f[3])
    return found


def blocked(profile, text):
    found = findings(profile, text)
    if any(f[4] == "CRITICAL" for f in found):
        return True
    policy = PROFILES[profile].policy
    if policy == "threshold":
        return any(f[3] >= 0.8 for f in found)
    floor = {"high80": 0.8, "high95": 0.95}[policy]
    hits = [f for f in found if f[4] == "HIGH" and f[3] >= floor]
    if policy == "high95":
        words = [text[f[1]:f[2]].lower().strip() for f in hits]
        return any(len(w) > 3 and w not in HARMLESS_WORDS for w in words)
    return bool(hits)
