"""BPE encoding and decoding with the backtracking method.

Text is cut into words as the public byte-level tokenizers cut it. A word is encoded from left
to right: at each place the longest token that matches there is tried, shorter ones follow. All
longest matches of a word come from one walk of an Aho-Corasick automaton over the reversed tokens,
from right to left: its failure links make the walk linear, however long tokens are. A token is taken if it is compatible with the one before
it, that is if merging the two tokens' bytes alone would give just these two; with no candidate
left the last token is given up again. Places found hopeless are remembered, so the work is
linear in the word. Many words are encoded side by side in numpy arrays; short words that came before
are looked up by their bytes in a table of bounded size.

Null texts count as empty, empty texts have no tokens. A text of any length is one unit of
work: it is never cut. The string of a special token in a text becomes its id.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textwarden.llm.common import distinct, documents, flat, ranges, slices

#: How the public byte-level tokenizers split text into words (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Letters and numbers of Unicode 16, which the tokenizers know and Python 3.13 does not (fixed values: first, last).
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_NONE = np.iinfo(np.int64).max
#: Ids and words that the table of words holds at most, and the longest word in it.
_POOL, _WORDS, KEPT_WORD = 1 << 22, 1 << 19, 64
#: Long words are walked in segments of so many bytes.
_SEGMENT = 1024


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for kind, new in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in new:
            out[a:b + 1] = kind
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


class Automaton:
    """Aho-Corasick automaton over byte strings of several kinds.

    `found[kind][state]` is the longest string of the kind that ends in the state, -1 if none does.
    """

    def __init__(self, *kinds: dict[bytes, int]):
        self.states: dict[int, int] = {}
        parent, depth = [0], [0]
        own: list[dict[int, int]] = [{} for _ in kinds]
        for strings, ends in zip(kinds, own, strict=True):
            for string, i in sorted(strings.items()):
                state = 0
                for b in string:
                    nxt = self.states.get(state << 8 | b)
                    if nxt is None:
                        nxt = self.states[state << 8 | b] = len(parent)
                        parent.append(state << 8 | b)
                        depth.append(depth[state] + 1)
                    state = nxt
                ends[state] = i
        fail, found = [0] * len(parent), [[-1] * len(parent) for _ in kinds]
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            above, b = parent[state] >> 8, parent[state] & 255
            if above:
                back = fail[above]
                while back and back << 8 | b not in self.states:
                    back = fail[back]
                fail[state] = self.states.get(back << 8 | b, 0)
            for ends, at in zip(own, found, strict=True):
                at[state] = ends.get(state, at[fail[state]])
        self.fail, self.found = np.array(fail, np.int32), [np.array(x, np.int32) for x in found]
        self.shorter = [{i: at[fail[state]] for state, i in ends.items()} for ends, at in zip(own, found, strict=True)]
        self.longest = max(depth)
        keys = np.fromiter(self.states, np.int64, len(self.states))
        order = np.argsort(keys)
        self._edges, self._to = keys[order], np.fromiter(self.states.values(), np.int32, len(keys))[order]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        out, at = state.astype(np.int64), np.arange(len(state))
        byte = byte.astype(np.int64)
        while len(at):
            key = out[at] << 8 | byte[at]
            place = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            hit = self._edges[place] == key
            stop = ~hit & (out[at] == 0)
            out[at[hit]] = self._to[place[hit]]
            at = at[~(hit | stop)]
            out[at] = self.fail[out[at]]
        return out


class Vocabulary:
    """Tokens, their automaton, their merges, and the offset table for decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        ids = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        n = max([*ids.values(), *self.special.values()]) + 1
        words = [b""] * n
        for word, i in [*ids.items(), *self.special.items()]:
            words[i] = word
        self.length = np.array([len(w) for w in words], np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self._merges(spec["model"]["merges"], ids, alphabet, n)
        self._automaton(ids, n)
        self._pairs = np.full(1 << 18, -1, np.int64)
        self._verdicts = np.zeros(1 << 18, bool)
        self.forget()

    def _merges(self, merges: list, ids: dict[bytes, int], alphabet: dict[str, int], n: int) -> None:
        left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        rank = np.full(n, _NONE, np.int64)
        raw = lambda word: bytes(alphabet[c] for c in word)
        pairs = np.empty(len(merges), np.int64)
        for i, merge in enumerate(merges):
            a, b = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            whole = ids[a + b]
            left[whole], right[whole], rank[whole] = ids[a], ids[b], i
            pairs[i] = ids[a] << 32 | ids[b]
        order = np.argsort(pairs, kind="stable")
        self._merge_pairs, self._merge_ranks = pairs[order], order.astype(np.int64)
        self._left, self._right = self._spine(left, rank), self._spine(right, rank)

    @staticmethod
    def _spine(child: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each token itself, then the part at its edge, and so on: the part, and the rank of the merge that ends it."""
        part, ends = np.arange(len(child), dtype=np.int64), np.full(len(child), _NONE, np.int64)
        out = []
        while (part >= 0).any():
            out.append((part, ends))
            ends = np.where(part >= 0, rank[part], -1)
            part = np.where(part >= 0, child[part], -1).astype(np.int64)
        return out

    def _automaton(self, ids: dict[bytes, int], n: int) -> None:
        """Over the reversed tokens: what ends in a state is the longest token that starts at a place."""
        self._tokens = Automaton({word[::-1]: i for word, i in ids.items()})
        self._shorter = np.full(n, -1, np.int32)
        self._shorter[list(self._tokens.shorter[0])] = list(self._tokens.shorter[0].values())

    def longest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token that starts at each place of each word (ranges of `data`) and ends in it.

        A long word is walked in segments side by side, each from as far right of it as tokens reach.
        """
        found = np.full(len(data), -1, np.int32)
        pieces = -(-(ends - starts) // _SEGMENT)
        word = np.repeat(np.arange(len(starts)), pieces)
        first = starts[word] + ranges(np.zeros(len(starts), np.int64), pieces) * _SEGMENT
        last = np.minimum(first + _SEGMENT, ends[word])
        top = np.minimum(last + self._tokens.longest, ends[word])
        order = np.argsort(first - top, kind="stable")
        first, last, top = first[order], last[order], top[order]
        size, state = first - top, np.zeros(len(first), np.int64)
        for k in range(int(-size[0]) if len(size) else 0):
            m = int(np.searchsorted(size, -k))
            at = top[:m] - 1 - k
            state = self._tokens.step(state[:m], data[at])
            own = at < last[:m]
            found[at[own]] = self._tokens.found[0][state[own]]
        return found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of tokens `a` and `b` together encode to just these two tokens."""
        pair = a.astype(np.int64) << 32 | b
        slot = _slots(pair, len(self._pairs))
        known = self._pairs[slot] == pair
        if not known.all():
            new, where = np.unique(pair[~known], return_inverse=True)
            verdict = self._check(new >> 32, new & 0xFFFFFFFF)
            out = self._verdicts[slot]
            out[~known] = verdict[where]
            put, only = np.unique(_slots(new, len(self._pairs)), return_index=True)
            self._pairs[put], self._verdicts[put] = new[only], verdict[only]
            return out
        return self._verdicts[slot]

    def _check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A merge across the border happens if both its parts exist when its turn comes.

        A part exists until the merge that takes it up. Of equal merges the left one comes first.
        """
        out = np.ones(len(a), bool)
        for right, until_right in self._right:
            x, x_ends = right[a], until_right[a]
            if not (x >= 0).any():
                break
            for left, until_left in self._left:
                y, y_ends = left[b], until_left[b]
                real = (x >= 0) & (y >= 0)
                if not real.any():
                    break
                pair = x << 32 | y
                at = np.minimum(np.searchsorted(self._merge_pairs, pair), len(self._merge_pairs) - 1)
                rank = self._merge_ranks[at]
                out &= ~(real & (self._merge_pairs[at] == pair) & (rank < x_ends) & (rank <= y_ends))
        return out

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (ranges of `data`), one word after another, and the count of each word."""
        n, length = len(starts), (ends - starts).astype(np.int64)
        base = np.cumsum(length) - length
        text = data[ranges(starts, length)]
        word_end = base + length
        first = self.longest(text, base, word_end)
        dead = np.zeros(len(text) + 1, bool)
        taken = np.full(len(text) + 1, -1, np.int32)  # the token that starts at a place
        before = np.full(len(text) + 1, -1, np.int32)  # the token that ends at a place
        at, active = base.copy(), np.arange(n)[length > 0]
        candidate = np.full(n, -1, np.int32)
        candidate[active] = first[base[active]]
        last = np.full(n, -1, np.int32)
        while len(active):
            place, token = at[active], candidate[active]
            none = token < 0
            if none.any():  # give the last token up and try a shorter one
                back = active[none]
                spot = at[back]
                dead[spot] = True
                token_back = last[back]
                if (token_back < 0).any():
                    raise ValueError("a word cannot be encoded: the vocabulary lacks a byte")
                spot = spot - self.length[token_back]
                at[back], candidate[back] = spot, self._shorter[token_back]
                last[back] = np.where(spot > base[back], before[spot], -1)
            go, place, token = active[~none], place[~none], token[~none]
            to = place + self.length[token]
            fits = (to == word_end[go]) | ~dead[np.minimum(to, len(text))]
            previous = last[go]
            ask = fits & (previous >= 0)
            fits[ask] = self.compatible(previous[ask], token[ask])
            no = go[~fits]
            candidate[no] = self._shorter[token[~fits]]
            yes, spot, token, to = go[fits], place[fits], token[fits], to[fits]
            taken[spot], at[yes], last[yes] = token, to, token
            more = to < word_end[yes]
            before[to[more]] = token[more]
            candidate[yes[more]] = first[to[more]]
            done = np.zeros(n, bool)
            done[yes[~more]] = True
            active = active[~done[active]]
        # walk the taken tokens: later attempts overwrite earlier ones, so only reachable places count
        counts, out, order = np.zeros(n, np.int64), [], []
        live, place = np.arange(n)[length > 0], base[length > 0]
        while len(live):
            token = taken[place]
            out.append(token)
            order.append(live)
            counts[live] += 1
            place = place + self.length[token]
            more = place < word_end[live]
            live, place = live[more], place[more]
        if not out:
            return np.zeros(0, np.uint16), counts
        by = np.argsort(np.concatenate(order), kind="stable")
        return np.concatenate(out)[by].astype(np.uint16 if len(self.length) <= 65536 else np.int32), counts

    def forget(self) -> None:
        """Empty the table of words."""
        self._words: dict[bytes, tuple[int, int]] = {}
        self._pool, self._used = np.zeros(1 << 16, np.uint16 if len(self.length) <= 65536 else np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._used:self._used + len(ids)] = ids
        self._used += len(ids)
        return self._used - len(ids)

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in `data`, one text after another, and the place of each text in them."""
        if self._used > _POOL or len(self._words) > _WORDS:
            self.forget()
        starts, specials = word_starts(data, offsets, tuple(self.special))
        if not len(starts):
            return self._pool[:0].copy(), np.zeros(len(offsets), np.int64)
        numbers, words = distinct(data, starts, np.append(starts[1:], len(data)))
        names = words.to_pylist()
        new = [i for i, x in enumerate(names) if x not in self._words]
        own: dict[bytes, tuple[int, int]] = {}
        if new:
            text, ends = flat(words.take(pa.array(new)))
            ids, counts = self.encode_words(text, ends[:-1], ends[1:])
            places = self._keep(ids) + np.cumsum(counts) - counts
            own = {names[i]: at for i, at in zip(new, zip(places.tolist(), counts.tolist(), strict=True), strict=True)}
            self._words.update((x, at) for x, at in own.items() if len(x) <= KEPT_WORD)
        places = np.array([own.get(x) or self._words[x] for x in names], np.int64)[numbers]
        at, count = places[:, 0], places[:, 1]
        if specials:
            index = np.searchsorted(starts, np.array([s for s, _ in specials]))
            place = self._keep(np.array([self.special[s] for _, s in specials], self._pool.dtype))
            at[index], count[index] = place + np.arange(len(specials)), 1
        ids = self._pool[ranges(at, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(starts, offsets)]

    def decode_flat(self, ids: np.ndarray) -> bytes:
        at = ids.astype(np.int64)
        return self.bytes[ranges(self.offsets[at], self.length[at].astype(np.int64))].tobytes()


def _slots(pair: np.ndarray, n: int) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (n - 1)


def word_starts(data: np.ndarray, offsets: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, list]:
    """Where the words of all texts in `data` start, and (start, string) of the special tokens."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), []
    classes = char_classes()
    kind = classes[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    odd = np.zeros(0, np.int64)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int64) & np.array([0x1F, 0x0F, 0x07])[size - 2]
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        own = classes[code]
        for k in (0, 1, 2, 3):
            kind[lead[size > k] + k] = own[size > k]
        odd = lead[own == SPACE]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = OTHER, kind[:-1]
    after[-1], after[:-1] = SPACE, kind[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    after[inner - 1] = SPACE
    space = kind == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = data[:-1] == 0x20
    first = begin[:n]
    start = np.where(space, (before != SPACE) | (after != SPACE), (before != kind) & ~blank_before) | first
    for i in np.flatnonzero(data == 0x27):
        if first[i] or (before[i] != OTHER and not blank_before[i]):
            end = next((i + len(c) for c in (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
                        if data[i:i + len(c)].tobytes() == c and not begin[i + 1:i + len(c)].any()), None)
            if end is not None:
                start[i] = True
                start[i + 1:end] = False
                if end < n and not (space[end] and not begin[end]):
                    start[end] = True
    found = []
    slow = set(np.searchsorted(offsets, odd, "right") - 1) if len(odd) else set()
    if specials:
        whole = data.tobytes()
        for s in specials:
            i = whole.find(s)
            while i >= 0:
                slow.add(int(np.searchsorted(offsets, i, "right")) - 1)
                i = whole.find(s, i + 1)
    for d in sorted(slow):  # white space beyond ASCII, special tokens: by the pattern itself
        a, b = int(offsets[d]), int(offsets[d + 1])
        start[a:b] = False
        places, special = _slow_starts(data[a:b].tobytes(), specials)
        start[a + np.array(places, np.int64)] = True
        found += [(a + i, s) for i, s in special]
    return np.flatnonzero(start), found


def _slow_starts(text: bytes, specials: tuple[bytes, ...]) -> tuple[list[int], list[tuple[int, bytes]]]:
    import re

    starts, found, at = [], [], 0
    parts = re.split(b"(" + b"|".join(map(re.escape, specials)) + b")", text) if specials else [text]
    for i, part in enumerate(parts):
        if i % 2:
            starts.append(at)
            found.append((at, part))
            at += len(part)
        else:
            for word in regex.findall(WORDS, part.decode("utf-8", "surrogatepass")):
                starts.append(at)
                at += len(word.encode("utf-8", "surrogatepass"))
    return starts, found


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of the batches with the ids of its texts and their places."""
    words = vocabulary(path)
    for batch in slices(batches):
        data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
        ids, places = words.encode_flat(data, offsets)
        yield batch, ids, places


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `ids` (array) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, places in encode_batches(path, batches):
            lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `text` from `ids`; bytes that form no character are replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [words.decode_flat(np.array(x or [], np.int64)).decode("utf-8", "replace")
                     for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its number of tokens, and digests of its ids and of the text that they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch, ids, places in encode_batches(path, batches):
            raw = ids.astype("<u4")
            shas, decoded = [], []
            for a, b in zip(places[:-1], places[1:], strict=True):
                shas.append(hashlib.sha256(raw[a:b].tobytes()).hexdigest())
                text = words.decode_flat(ids[a:b]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(places)), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
