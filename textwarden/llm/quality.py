"""Quality rules: base rules, then gradient-boosted trees over document statistics.

Statistics are counted per text. Trees are grown here with numpy on the statistics of a bounded
sample of labelled documents; features named in `MONOTONE` may only lower the score as they
rise. For scoring all trees are laid out in flat node arrays and walked for many documents at
once.

Null and empty texts have no words and fail the base rules. Each input row gives one row, so
repeated rows and ids repeat. Without usable labels of both kinds the base rules alone decide.
An empty table gives an empty result. Further columns stay behind. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import documents, slices

#: Labelled documents that the trees are fitted on, at most (those with the smallest hash of their id).
SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "mark_share", "line_words", "distinct_share", "digit_share")
#: Features that may only lower the score as they rise.
MONOTONE = ("symbol_share", "dup_line_share", "repeat_share")
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 32, 20, 1.0


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(known)
    _, pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
    _, window, count = np.unique(pairs.astype(np.int64) * n + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= again
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the features of a text in UTF-8."""
    words = text.split()
    spread = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    points = int(len(text) - spread[0x80:0xC0].sum())
    word_chars = points - int(spread[[0x20, *range(0x09, 0x0E)]].sum())
    symbols = int(spread[list(SYMBOLS)].sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    n, dup, repeat = len(words), len(lines) - len(set(lines)), repeated_words(words)
    per = max(n, 1)
    chars = max(word_chars, 1)
    features = [np.log1p(n), word_chars / per, symbols / chars, dup / max(len(lines), 1), repeat / per,
                int(spread[0x41:0x5B].sum()) / chars, int(spread[[0x21, 0x3F]].sum()) / chars, n / max(len(lines), 1),
                len(set(words)) / per, int(spread[0x30:0x3A].sum()) / chars]
    return [n, word_chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray) -> Trees:
    """Boosted trees for the log odds of `y`; where `signs` is -1 (1) the score never rises (falls) with the feature."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    logit, nodes, roots = np.full(len(x), start), [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        roots.append(len(nodes))
        _grow(codes, cuts, y - p, p * (1 - p), np.arange(len(x)), signs, nodes, 0, -np.inf, np.inf, logit)
    feature, threshold, left, right, value = map(np.array, zip(*nodes, strict=True))
    return Trees(feature, threshold, left, right, value, np.array(roots), start)


def _grow(codes, cuts, g, h, rows, signs, nodes, depth, low, high, logit) -> int:
    """Adds a node for `rows`, whose leaf values must lie in [low, high]; returns its number."""
    at = len(nodes)
    leaf = float(np.clip(g[rows].sum() / (h[rows].sum() + RIDGE), low, high))
    nodes.append((0, np.inf, at, at, 0.0))
    best = (1e-6, None)
    if depth < DEPTH and len(rows) >= 2 * LEAST:
        whole = g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
        for f, cut in enumerate(cuts):
            code, m = codes[rows, f], len(cut) + 1
            gs, hs, ns = (np.cumsum(np.bincount(code, w, m))[:-1] for w in (g[rows], h[rows], None))
            gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
            vl, vr = (np.clip(a / (b + RIDGE), low, high) for a, b in ((gs, hs), (gr, hr)))
            gain = gs ** 2 / (hs + RIDGE) + gr ** 2 / (hr + RIDGE) - whole
            ok = (ns >= LEAST) & (len(rows) - ns >= LEAST) & ((vr - vl) * signs[f] >= 0)
            if ok.any() and (k := int(np.argmax(np.where(ok, gain, -np.inf)))) >= 0 and gain[k] > best[0]:
                best = (gain[k], (f, k, vl[k], vr[k]))
    if best[1] is None:
        nodes[at] = (0, np.inf, at, at, RATE * leaf)
        logit[rows] += RATE * leaf
        return at
    f, k, vl, vr = best[1]
    goes_left = codes[rows, f] <= k
    middle = (vl + vr) / 2
    bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[int(signs[f])]
    sides = [_grow(codes, cuts, g, h, rows[side], signs, nodes, depth + 1, *b, logit)
             for side, b in zip((goes_left, ~goes_left), bounds, strict=True)]
    nodes[at] = (f, float(cuts[f][k]), *sides, 0.0)
    return at


def measured(docs: DataFrame, model: Trees | None = None, *extra: str) -> DataFrame:
    """`doc_id`, `extra`, the counts, the features as an array and, with a model, its `score`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [statistics(t) for t in batch.column(1).to_pylist()]
            counts, features = np.array([c for c, _ in both], np.int64), np.array([f for _, f in both], np.float64)
            score = np.full(len(both), np.nan) if model is None else model.score(features)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(2 + i) for i in range(len(extra))), *(pa.array(counts[:, i]) for i in range(len(COUNTS))),
                 pa.array(list(features), pa.list_(pa.float64())), pa.array(score)],
                ["doc_id", *extra, *COUNTS, "features", "score"])

    chosen = documents(docs, *extra).withColumn("text", F.col("text").cast("binary"))
    kinds = ", ".join([*(f"{c} {dict(docs.dtypes)[c]}" for c in extra), *(f"{c} long" for c in COUNTS)])
    return chosen.mapInArrow(run, f"doc_id long, {kinds}, features array<double>, score double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on at most `sample` labelled documents."""
    chosen = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = measured(texts, None, "quality").select("doc_id", "quality", "features").limit(2 * sample).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return None
    signs = np.array([-1 if f in MONOTONE else 0 for f in FEATURES])
    return fit(np.array([r.features for r in rows]), y, signs)


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per document its counts, `base_failed`, `kept`, and the `score` of the trees."""
    model = train(docs, labels, sample)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.lit(True) if model is None else F.col("score") >= least
    return (measured(docs, model).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
            .select("doc_id", *COUNTS, "base_failed", "kept", "score"))
