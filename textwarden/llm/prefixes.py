"""Exact token counts of every prefix of a text, by dynamic programming.

The encoding of a prefix ends with exactly one token: the one that is compatible with the last token
of the prefix before it. So one walk over a word gives each prefix its last token and its count; an
automaton over all tokens names the few tokens that can end at a place. The vocabulary marks the end
of a word, so at each place two tokens are found: the one with which a longer word goes on, and the
one that ends a word here. The second gives the count. Words are walked side by side in numpy.

With the counts stored, `longest_prefix` says where to cut a text for a budget and `tokens_at` what
a prefix costs, without encoding again.

Prefixes are those of the text in NFC, one for each code point and the empty one. Each count is what
the tokenizers library gives for that prefix as a text of its own: so a prefix that ends within a
special token's string counts its characters, and the whole string counts once. Null texts are empty;
an empty text has the one count 0. Repeated rows stay, order and ids do not matter, empty tables give
no rows, other columns stay behind. A text is one unit of work and is never cut: about 40 times its
bytes are held while it is counted.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm import bpe
from textwarden.llm.common import distinct, documents, flat, ranges, slices

#: How the vocabulary writes the end of a word, and endings that are words of their own (fixed values).
MARK = b"</w>"
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Words walked side by side at least; longer ones go on alone. Counts kept.
FEW, KEPT_COUNTS = 8, 1 << 22
DOTTED_I, DOT = 0x130, 0x307
#: Lower case that the tokenizers know and Python 3.13 does not (fixed values: first, last, lower case of the first).
NEW_CASES = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
             (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
             (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]


@lru_cache(1)
def lower_case() -> np.ndarray:
    """The lower case of each code point, alone; of the one that has two, the first."""
    out = np.array([ord(chr(c).lower()[0]) for c in range(sys.maxunicode + 1)], np.uint32)
    for a, b, lower in NEW_CASES:
        out[a:b + 1] = np.arange(lower, lower + b - a + 1)
    return out


class Vocabulary(bpe.Vocabulary):
    """Tokens as bytes, with or without the mark, the merges, and an automaton of what can end at a place."""

    def _automaton(self, ids: dict[bytes, int], n: int) -> None:
        bodies: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})  # without the mark and with it
        self.size, self._shorter = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for word, i in ids.items():
            ends = word.endswith(MARK) and word != MARK
            body = word[:-len(MARK)] if ends else word
            bodies[ends][body], self.size[i] = i, len(body)
        self._tokens = bpe.Automaton(*bodies)
        for shorter in self._tokens.shorter:
            self._shorter[list(shorter)] = list(shorter.values())
        self._plain, self._ending = self._tokens.found
        self._known: dict[tuple[int, int], bool] = {}

    def forget(self) -> None:
        """Empty the table of words."""
        self._words: dict[bytes, tuple[int, int]] = {}
        self._pool, self._used = np.zeros(1 << 16, np.int32), 0

    def _last_tokens(self, found: np.ndarray, at: np.ndarray, k: int, last: np.ndarray,
                     counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words at their byte `k`: the token that ends there and the count of the prefix."""
        token, count, todo = found.copy(), np.ones(len(at), np.int64), np.arange(len(at))
        while len(todo):
            now = token[todo]
            if (now < 0).any():
                raise ValueError("a word cannot be encoded: the vocabulary lacks a byte")
            place = at[todo] - self.size[now]
            fits = self.size[now] == k + 1
            count[todo] = np.where(fits, 1, counts[place] + 1)
            ask = ~fits
            fits[ask] = self.compatible(last[place[ask]], now[ask])
            todo = todo[~fits]
            token[todo] = self._shorter[token[todo]]
        return token, count

    def walk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each byte of each word: the count of the prefix that ends with it, as a word of its own."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        base, ordered = offsets[:-1][order], -sizes[order]
        last, counts = np.full(len(data) + 1, -1, np.int64), np.zeros(len(data) + 1, np.int64)
        out = np.zeros(len(data), np.int32)
        ends = np.ones(len(data), bool)  # of characters; elsewhere no word can end
        ends[:-1] = data[1:] & 0xC0 != 0x80
        state = np.zeros(len(sizes), np.int64)
        for k in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(ordered, -k))
            if m < FEW and k > bpe.KEPT_WORD:
                for i in range(m):
                    self._walk_on(data, int(base[i]), k, int(-ordered[i]), int(state[i]), ends, last, counts, out)
                break
            at = base[:m] + k
            state = self._tokens.step(state[:m], data[at])
            last[at], counts[at] = self._last_tokens(self._plain[state], at, k, last, counts)
            stop = ends[at]
            out[at[stop]] = self._last_tokens(self._ending[state[stop]], at[stop], k, last, counts)[1]
        return out

    def _walk_on(self, data: np.ndarray, base: int, k: int, size: int, state: int, ends: np.ndarray,
                 last: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """The rest of one long word."""
        text, known, sizes = data[base:base + size].tobytes(), self._known, self.size
        states, fail = self._tokens.states, self._tokens.fail
        own, count = last[base:base + k].tolist(), counts[base:base + k].tolist()
        stops = ends[base:base + size].tolist()

        def find(token: int) -> tuple[int, int]:
            while True:
                place = k - int(sizes[token])
                if place < 0:
                    return token, 1
                pair = own[place], token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = bool(self._check(np.array(pair[:1]), np.array(pair[1:]))[0])
                if fits:
                    return token, count[place] + 1
                token = int(self._shorter[token])

        for k in range(k, size):  # noqa: B020, PLR1704
            while state and state << 8 | text[k] not in states:
                state = int(fail[state])
            state = states.get(state << 8 | text[k], 0)
            if stops[k]:
                out[base + k] = find(int(self._ending[state]))[1]
            token, n = find(int(self._plain[state]))
            own.append(token)
            count.append(n)
        if len(known) > KEPT_COUNTS:
            known.clear()

    def word_counts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place in the pool of counts, one for each character, and its length there."""
        if self._used > KEPT_COUNTS:
            self.forget()
        names = words.to_pylist()
        new = [x for x in names if x not in self._words]
        own: dict[bytes, tuple[int, int]] = {}
        if new:
            data, offsets = flat(pa.array(new, pa.large_binary()))
            counts = self.walk(data, offsets)
            shown = counts > 0
            places = np.concatenate([[0], np.cumsum(shown)])[offsets]
            counts = counts[shown]
            while self._used + len(counts) > len(self._pool):
                self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
            self._pool[self._used:self._used + len(counts)] = counts
            sizes = np.diff(places).tolist()
            own = {x: (a, n) for x, a, n in zip(new, (places[:-1] + self._used).tolist(), sizes, strict=True)}
            self._words.update((x, at) for x, at in own.items() if len(x) <= bpe.KEPT_WORD)
            self._used += len(counts)
        found = [own.get(x) or self._words[x] for x in names]
        return np.array([a for a, _ in found], np.int64), np.array([n for _, n in found], np.int64)


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _runs_of(text: str, specials: list[str]) -> list[tuple[str, int]]:
    """The text in NFC, cut at special tokens: each run with the rest of its token but for the last character, and its own length."""
    parts = re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if specials else [text]
    own = [unicodedata.normalize("NFC", x) for x in parts[::2]]
    return [(x + (parts[2 * i + 1][:-1] if 2 * i + 1 < len(parts) else ""), len(x)) for i, x in enumerate(own)]


def _starts(kind: np.ndarray, code: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and the second characters of endings of three."""
    n = len(code)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == bpe.NUMBER)
    start |= begin
    start &= kind != bpe.SPACE
    middle = []
    text = None
    for i in np.flatnonzero((code == 0x27) & start):
        if text is None:
            text = code.astype(np.uint32).tobytes().decode("utf-32-le")
        end = next((i + len(x) for x in ENDINGS if text.startswith(x, i) and not begin[i + 1:i + len(x)].any()), None)
        if end is not None:
            start[i + 1:end] = False
            if end - i == 3:
                middle.append(i + 1)
            if end < n and kind[end] != bpe.SPACE:
                start[end] = True
    return start, np.array(middle, np.int64)


def _counted(words: Vocabulary, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts after each character of each run, and where each run starts."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)
    raw = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
    code, place = lower_case()[raw], None
    if (raw == DOTTED_I).any():  # the one character whose lower case is two
        times = 1 + (raw == DOTTED_I)
        place = np.cumsum(times) - 1
        code = np.repeat(code, times)
        code[place[raw == DOTTED_I]] = DOT
        shifted = np.concatenate([[0], place + 1])[bounds]
    else:
        shifted = bounds
    n = len(code)
    out = np.zeros(n, np.int64)
    kind = bpe.char_classes()[code]
    begin = np.zeros(n + 1, bool)
    begin[shifted] = True
    start, middle = _starts(kind, code, begin[:n])
    first = np.flatnonzero(start)
    if len(first):
        inner = kind != bpe.SPACE
        last = np.flatnonzero(inner & np.concatenate([start[1:] | ~inner[1:], [True]])) + 1
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8)
        numbers, names = distinct(data, at[first], at[last])
        pool, sizes = words.word_counts(names)
        pool, sizes = pool[numbers], sizes[numbers]
        totals = np.concatenate([[0], np.cumsum(words._pool[pool + sizes - 1])])
        out = totals[np.cumsum(start)]
        chars = ranges(first, sizes)
        out[chars] = words._pool[ranges(pool, sizes)] + np.repeat(totals[:-1], sizes)
        if len(middle):  # of an ending of three, the first two are two words
            out[middle] = totals[np.cumsum(start)[middle] - 1] + 2
        before = totals[np.searchsorted(first, shifted[:-1])]
        out -= np.repeat(before, np.diff(shifted))
    return (out if place is None else out[place]), bounds


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `n_bytes`, `counts`: the tokens of each prefix of the text, from the empty one to the whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        specials = [x.decode() for x in words.special]
        some = re.compile("|".join(map(re.escape, specials))) if specials else None
        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            texts = column.to_pylist()
            cut = {i: _runs_of(x, specials) for i, x in enumerate(texts) if some and some.search(x)}
            runs, first = [], []
            for i, x in enumerate(texts):
                first.append(len(runs))
                runs += [r for r, _ in cut[i]] if i in cut else [x if unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x)]
            counts, bounds = _counted(words, runs)
            ends = bounds[1:][np.array([*first[1:], len(runs)]) - 1] if runs else bounds[1:]
            sizes = np.diff(np.concatenate([[0], ends]))
            bases = np.zeros(len(runs), np.int64)  # the count before each run
            for i, own in cut.items():  # each special token is one more
                total = 0
                for r, (_, size) in enumerate(own, first[i]):
                    bases[r] = total
                    counts[bounds[r]:bounds[r + 1]] += total
                    total = (int(counts[bounds[r] + size - 1]) if size else total) + 1
            counts = np.insert(counts, bounds[:-1], bases)
            lists = np.concatenate([[0], np.cumsum(sizes + [len(cut.get(i, [0])) for i in range(len(texts))])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(flat(column)[1])),
                 pa.LargeListArray.from_arrays(pa.array(lists), pa.array(counts.astype(np.int32))).cast(pa.list_(pa.int32()))],
                ["doc_id", "n_bytes", "counts"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, counts array<int>")


def tokens_at(counts: Column, place: Column | int) -> Column:
    """The tokens of the prefix of `place` characters; null beyond the text."""
    return F.try_element_at(counts, (F.lit(place) if isinstance(place, int) else place) + 1)


def longest_prefix(counts: Column, budget: int) -> Column:
    """The characters of the longest prefix with at most `budget` tokens (counts may fall again as a word goes on)."""
    fits = F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True)
    return F.when(fits > 0, F.size(counts) - fits)


def report(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per document: its bytes and tokens, and whether these pass the limit."""
    return prefix_counts(docs, path).select(
        "doc_id", "n_bytes", F.element_at("counts", -1).cast("long").alias("n_tokens"),
        (F.element_at("counts", -1) > limit).alias("over_limit"))
