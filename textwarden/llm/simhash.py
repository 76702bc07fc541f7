"""Near-duplicate documents by SimHash, linked with a self-join of binary tries.

A fingerprint holds one bit per bit of the shingle hashes: 1 where more than half of them have
it. Two fingerprints are linked at `max_bits` or fewer differing bits. Among `max_bits + 1`
blocks of bits one must then be equal, so each distinct fingerprint goes to one bucket per
block; in a bucket the trie over the remaining bits is joined with itself: pairs of nodes are
followed down together, differing bits are counted, and a pair is dropped once it has too many.
A bucket reports a spanning forest of its links, never all pairs. Connected components come
from repeated contraction of that forest.

Null and empty texts have fingerprint zero, like any text without words, and are linked like
any other. Equal texts, repeated ids and repeated rows share a fingerprint and so a component;
each input row gives one output row. An empty table gives an empty result. Further columns stay
behind. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import cut_lineage, documents, fresh, slices

#: Fingerprints that a bucket should hold, and pairs of nodes that are followed at a time.
BUCKET = 1 << 15
FRONT = 1 << 18
#: Pairs of nodes with as many pairs of leaves are compared leaf by leaf.
LEAVES = 16


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    parts = text.lower().split()  # on bytes: A-Z, and the ASCII white space
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts])
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist(), strict=True)]


def fingerprint_of(hashes: list[int]) -> int:
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = counts * 2 > len(values)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """`doc_id`, `fp` (the 64 bits as a long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint_of(shingle_hashes(text, words, seed)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return (documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def block_widths(blocks: int) -> list[int]:
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


class Forest:
    """Components of numbered items, each named by its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_links(values: np.ndarray, skip: int, max_bits: int) -> Forest:
    """Components of sorted distinct 64-bit values that agree in their first `skip` bits and differ in at most `max_bits`."""
    forest = Forest(len(values))
    ones = [np.concatenate([[0], np.cumsum(values >> np.uint64(63 - d) & np.uint64(1))]).astype(np.int64)
            for d in range(skip, 64)]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] >> np.uint64(64 - skip) != values[:-1] >> np.uint64(64 - skip)]))
    tails = np.append(heads[1:], len(values))
    big = tails - heads > 1
    heads, tails = heads[big], tails[big]
    # a pair of nodes: leaves [a0, a1) and [b0, b1), and their differing bits so far
    todo = [(skip, heads, tails, heads, tails, np.zeros(len(heads), np.int8))]
    while todo:
        depth, a0, a1, b0, b1, bits = todo.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            todo.append((depth, *(x[half:] for x in (a0, a1, b0, b1, bits))))
            a0, a1, b0, b1, bits = (x[:half] for x in (a0, a1, b0, b1, bits))
            todo.append((depth, a0, a1, b0, b1, bits))
            continue
        few = (a1 - a0) * (b1 - b0) <= LEAVES
        _leaf_pairs(values, forest, a0[few], a1[few], b0[few], b1[few], max_bits)
        a0, a1, b0, b1, bits = (x[~few] for x in (a0, a1, b0, b1, bits))
        if not len(a0):
            continue
        count = ones[depth - skip]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0
        sides = ((a0, am, b0, bm, bits, None), (am, a1, bm, b1, bits, None),
                 (a0, am, bm, b1, bits + 1, None), (am, a1, b0, bm, bits + 1, ~same))
        for x0, x1, y0, y1, d, only in sides:
            keep = (x1 > x0) & (y1 > y0) & (d <= max_bits)
            if only is not None:
                keep &= only
            keep &= ~((x0 == y0) & (x1 - x0 == 1))
            if keep.any():
                todo.append((depth + 1, x0[keep], x1[keep], y0[keep], y1[keep], d[keep]))
    return forest


def _leaf_pairs(values: np.ndarray, forest: Forest, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray,
                b1: np.ndarray, max_bits: int) -> None:
    n = (a1 - a0) * (b1 - b0)
    total = int(n.sum())
    if not total:
        return
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    wide = (b1 - b0)[pair]
    a, b = a0[pair] + k // wide, b0[pair] + k % wide
    near = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= max_bits)
    near[near] = forest.root[a[near]] != forest.root[b[near]]
    forest.join(a[near], b[near])


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """`u`, `v`: a spanning forest of the links in each bucket between the distinct values `fp`."""
    widths = block_widths(max_bits + 1)
    shifts = [sum(widths[:k]) for k in range(len(widths))]
    turned = F.array(*(F.struct(F.lit(k).alias("block"), _turned("fp", s).alias("v"),
                                F.shiftrightunsigned(_turned("fp", s), 64 - widths[k]).alias("key"))
                       for k, s in enumerate(shifts)))
    rows = fps.count()
    buckets = max(1, -(-rows // BUCKET))
    dealt = (fps.select(F.explode(turned).alias("x")).select("x.*")
             .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["block"].iloc[0])
        values = np.sort(frame["v"].to_numpy().view(np.uint64))
        root = trie_links(values, widths[k], max_bits).root
        child = np.flatnonzero(root != np.arange(len(values)))
        s = shifts[k]
        back = values if not s else values >> np.uint64(s) | values << np.uint64(64 - s)
        return pd.DataFrame({"u": back[child].view(np.int64), "v": back[root[child]].view(np.int64)})

    return dealt.groupBy("block", "bucket").applyInPandas(run, "u long, v long").distinct()


def _turned(name: str, by: int) -> F.col:
    value = F.col(name)
    return value if not by else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def components(edges: DataFrame) -> DataFrame:
    """`v`, `root` of every vertex of `u`, `v` edges: equal roots mark a component.

    Each vertex takes its smallest neighbour, that neighbour's choice, and so on to the end; then
    edges are contracted. Every round at least halves the vertices that still have edges.
    """
    edges = cut_lineage(edges)
    both = edges.select(F.col("u").alias("v")).union(edges.select("v")).distinct()
    found = cut_lineage(both.withColumn("root", F.col("v")))
    while not edges.isEmpty():
        ends = edges.union(edges.select("v", "u")).toDF("x", "y")
        up = cut_lineage(ends.groupBy("x").agg(F.least("x", F.min("y")).alias("to")))
        while True:  # to the end of each chain of choices, in steps that double
            ends = up.select(F.col("x").alias("to"), F.col("to").alias("then"))
            jumped = cut_lineage(up.join(ends, "to").select("x", "to", "then"))
            up = jumped.select("x", F.col("then").alias("to"))
            if jumped.where("to <> then").isEmpty():
                break
        first, second = up.toDF("u", "a"), up.toDF("v", "b")
        edges = cut_lineage(edges.join(first, "u").join(second, "v").where("a <> b")
                            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        found = cut_lineage(found.join(up.toDF("root", "to"), "root", "left")
                            .select("v", F.coalesce("to", "root").alias("root")))
    return found


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hexadecimal digits), `component_id` (smallest `doc_id` reachable over links)."""
    marked = cut_lineage(fingerprints(docs, words, seed))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("v", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return (marked.join(by_fp, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def representatives(docs: DataFrame, words: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """One row of `docs` for each component: of the smallest `doc_id`, then of the least text hash.

    Rows without an id come after all others. Rows that share an id stand for themselves: each one
    belongs to the component of its own text, so an id can stay more than once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # equal texts share a fingerprint, so a text stands for its rows; the texts themselves are not shuffled
    texts = cut_lineage(docs.groupBy(F.sha2(text, 256).alias("hash"), F.xxhash64(text).alias("doc_id")).agg(F.min(F.col("doc_id").cast("long")).alias("id")))
    marked = (near_duplicates(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), words, seed, max_bits)
              .groupBy("doc_id").agg(F.min("component_id").alias("component")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    keep = texts.join(marked, "doc_id").groupBy("component").agg(first.alias("kept")).select("kept.*")
    a, b, c, d = fresh(docs.columns, "hash", "key", "kept_hash", "kept_id")
    keep = keep.select(F.col("id").alias(d), F.col("hash").alias(c))
    own = docs.withColumn(a, F.sha2(text, 256)).withColumn(b, F.col("doc_id").cast("long"))
    return (own.join(keep, F.col(a).eqNullSafe(F.col(c)) & F.col(b).eqNullSafe(F.col(d)), "left_semi")
            .dropDuplicates([a, b]).drop(a, b))
