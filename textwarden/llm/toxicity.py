"""Toxicity of texts, after undoing what hides words from a word list.

Digits and signs for letters, letters set apart and letters repeated are taken as noise of a
channel. A suspicious stretch becomes a lattice of the characters that it may stand for, and
the likeliest path under a trigram model of characters is found by the Viterbi method. The
model's counts come from all documents. The restored words are then scored: words and word
beginnings are weighted by how much likelier they are in toxic documents, and a logistic
function turns the document's evidence into a score.

Labels are read only of documents for which crc32(doc_id as text) mod 5 is not 0. Null and
empty texts have no evidence and the low score that follows from it. Each input row gives one
row, so repeated rows and ids repeat. Without labels of both kinds all scores are 0. An empty
table gives an empty result. Further columns stay behind. Texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import documents, slices

#: Labelled documents that weights and score are fitted on, at most (smallest hash of their id),
#: and features that the model keeps, at most (strongest evidence first).
SAMPLE, FEATURES = 12_000, 4096
#: Signs and what they may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Costs (negative log probabilities) of the channel: a sign for a letter, a sign kept, a letter dropped or doubled, a gap kept.
SIGN, KEPT, REPEAT, GAP = 1.0, 6.0, 0.7, 3.0
_LETTER = r"[^\W\d_]"
_TRIPLE = re.compile(rf"({_LETTER})\1\1", re.I)
_APART = re.compile(rf"(?:{_LETTER}[.\-_*]){{2,}}{_LETTER}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_@$!|+][ .\-_*]){2,}[^\W_](?!\S)")
_ENDS, _STARTS = "!|+.,;:?\"')%&*#", "!|+.,;:?\"'(%&*#"
_WORD = re.compile(rf"{_LETTER}+")
_SIDES = (4, 5, 6)
_GAPS = np.isin(np.arange(256), np.frombuffer(b" \t\n\r.-_*", np.uint8))
LETTERS = 29  # a word border, a to z, another letter, a digit or sign
OUT, OTHER, SIGNS = 0, 27, 28


def plain(char: str) -> str:
    """The letter without its accents, in lower case."""
    return unicodedata.normalize("NFKD", char.lower())[:1] or char


def code_of(char: str) -> int:
    base = plain(char)
    if "a" <= base <= "z":
        return ord(base) - 96
    return OTHER if char.isalpha() else SIGNS if char.isdigit() or char in LEET else OUT


@lru_cache(1)
def _codes() -> np.ndarray:
    return np.array([code_of(chr(c)) if not 0xD800 <= c < 0xE000 else OUT for c in range(0x3000)], np.int32)


def trigrams(text: str) -> np.ndarray:
    """Counts of three codes in a row; a border stands before and after the text and counts once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 0x3000, _codes()[np.minimum(points, 0x2FFF)], OTHER)
    codes = np.concatenate([[OUT, OUT], codes, [OUT]])
    keep = np.ones(len(codes), bool)
    keep[2:-1] = (codes[2:-1] != OUT) | (codes[1:-2] != OUT)
    codes = codes[keep]
    return np.bincount((codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:], minlength=LETTERS ** 3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a code after two others, counted over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS ** 3, np.int64)
        for batch in slices(batches):
            total += trigrams(" \n ".join(batch.column(1).to_pylist()))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["code", "n"])

    rows = documents(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.full((LETTERS,) * 3, 0.01)
    for code, n in rows:  # at most LETTERS ** 3
        counts.reshape(-1)[code] += n
    return np.log(counts / counts.sum(2, keepdims=True))


def suspicious(token: str) -> str:
    """The part of a token that may hide a word; empty if nothing in it is noisy."""
    core = token.rstrip(_ENDS)
    core = (core.rstrip("$") if core.endswith("$$$") else core).lstrip(_STARTS)
    if core.isalpha():
        return core if _TRIPLE.search(core) else ""
    signs = any(c in LEET for c in core) and any(c.isalpha() for c in core)
    return core if signs or _TRIPLE.search(core) or _APART.fullmatch(core) else ""


class Restorer:
    """Viterbi decoding of suspicious stretches of text."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def text(self, text: str) -> str:
        """`text` with every suspicious stretch restored."""
        joined = _SPACED.sub(lambda m: self.stretch(m.group()), text)
        return re.sub(r"\S+", lambda m: self.token(m.group()), joined)

    def token(self, token: str) -> str:
        core = suspicious(token)
        return token.replace(core, self.stretch(core), 1) if core else token

    def stretch(self, stretch: str) -> str:
        return self.decode(lattice(stretch))

    def decode(self, columns: list[list[tuple[str, float]]]) -> str:
        """The likeliest text of a lattice: columns of (characters, cost)."""
        best = {(OUT, OUT): (0.0, None)}
        for column in [*columns, [(" ", 0.0)]]:
            after: dict = {}
            for (a, b), (cost, path) in best.items():
                for chars, own in column:
                    x, y, total, way = a, b, cost + own, path
                    for c in chars:
                        code = code_of(c)
                        total -= self.model[x][y][code]
                        x, y = (y, code) if code else (OUT, OUT)
                        way = (way, c)
                    old = after.get((x, y))
                    if old is None or total < old[0]:
                        after[x, y] = (total, way)
            best = after
        _, path = min(best.values(), key=lambda v: v[0])
        chars = []
        while path is not None:
            path, c = path
            chars.append(c)
        return "".join(reversed(chars)).rstrip()


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """What each place of a stretch may stand for."""
    columns, at, n = [], 0, len(stretch)
    apart = n > 4 and all(not c.isalnum() for c in stretch[1::2])
    while at < n:
        c = stretch[at]
        end = at
        while end < n and stretch[end].lower() == c.lower():
            end += 1
        if c.isalpha():
            one = [(c, 0.0)]
            if end - at >= 3:  # a run stands for one or two letters
                columns.append([(c, REPEAT), (c + c, REPEAT)])
                at = end
                continue
            columns.append(one)
        elif c in LEET:
            columns.append([(x, SIGN) for x in LEET[c]] + [(c, KEPT)])
        elif apart:
            columns.append([("", 0.0), (" ", GAP)])
        else:
            columns.append([(c, 0.0)])
        at += 1
    return columns


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in _SIDES if len(word) > k)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_spaced(text: str) -> bool:
    """Whether single characters stand apart three times in a row."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)  # a byte for each character
    if len(raw) < 5:
        return False
    gap = _GAPS[raw]
    single = ~gap & np.concatenate([[True], gap[:-1]]) & np.concatenate([gap[1:], [True]])
    return bool((single[:-4] & single[2:-2] & single[4:]).any())


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """`doc_id`, `text`, `toxic` of the documents to learn from."""
    chosen = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounded, so it may be broadcast
    return documents(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic")


def held_out() -> F.col:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


class Scorer:
    """Evidence of a text, and its score."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], line: np.ndarray | None = None):
        self.restorer, self.weights, self.line = Restorer(model), weights, line
        self._known: dict[str, float] = {}
        self._tokens: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= 50_000:
                self._known.clear()
            found = max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0)
            self._known[word] = found
        return found

    def token(self, token: str) -> float:
        """The largest weight of the words in a token."""
        found = self._tokens.get(token)
        if found is None:
            if len(self._tokens) >= 50_000:
                self._tokens.clear()
            found = max(map(self.weight, words_of(self.restorer.token(token))), default=0.0)
            self._tokens[token] = found
        return found

    def evidence(self, text: str) -> list[float]:
        """The two largest weights of distinct tokens, and the logarithm of their sum."""
        found = [w for w in map(self.token, set(text.split())) if w]
        if has_spaced(text):
            found += [max(map(self.weight, self.spaced(m.group())), default=0.0) for m in _SPACED.finditer(text)]
        found.sort(reverse=True)
        return [found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, float(np.log1p(sum(found)))]

    def spaced(self, stretch: str) -> list[str]:
        """Words that letters set apart may form; a leading single word (`a`, `I`) may belong to the text before."""
        restored = words_of(self.restorer.stretch(stretch))
        return restored + [w[1:] for w in restored[:1]]

    def features(self, text: str) -> set[str]:
        words = {w for token in set(text.split()) for w in words_of(self.restorer.token(token))}
        if has_spaced(text):
            words |= {w for m in _SPACED.finditer(text) for w in self.spaced(m.group())}
        return {f for w in words for f in features_of(w)}

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.line, [1.0, *self.evidence(text)]), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Weights from one half of the labelled sample, the score's line from the other."""
    model = language_model(docs)
    texts = _labelled(docs, labels, sample).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    bare = Scorer(model, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            seen, toxic = Counter({"": batch.num_rows}), Counter({"": sum(batch.column(2).to_pylist())})
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = bare.features(text)
                seen.update(own)
                if y:
                    toxic.update(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()),
                 pa.array([toxic[f] for f in seen], pa.int64())], ["feature", "n", "bad"])

    counted = (texts.where("half = 0").select("doc_id", "text", "toxic").mapInArrow(count, "feature string, n long, bad long")
               .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    odds = F.log((F.col("bad") + 0.1) / (F.col("n") - F.col("bad") + 0.5))
    strong = (counted.where("bad >= 3 AND bad >= 0.5 * n AND feature <> ''").withColumn("odds", odds)
              .orderBy(F.desc("bad"), "feature").limit(FEATURES).select("feature", "odds"))
    weights = {r.feature: max(r.odds, 0.0) + 0.1 for r in strong.collect()}
    scorer = Scorer(model, weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [scorer.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = (texts.where("half = 1").select("doc_id", "text", "toxic").mapInArrow(weigh, "doc_id long, toxic int, x array<double>")
            .limit(2 * sample).collect())
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.toxic for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return None
    x = np.column_stack([np.ones(len(rows)), np.array([r.x for r in rows])])
    line = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        line += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(line)), x.T @ (y - p) - 0.05 * line)
    scorer.line = line
    return scorer


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document `held_out`, `score`, `predicted`."""
    scorer = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [0.0 if scorer is None else scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns kept."""
    scorer = train(docs, labels, sample)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array([scorer is None or scorer.score(t or "") < 0.5 for t in texts]))

    return docs.mapInArrow(run, docs.schema)
