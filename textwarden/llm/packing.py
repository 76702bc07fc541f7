"""Best-fit packing of tokenised documents into sequences with a grouping genetic algorithm.

A document's ids, then the end id, are cut into pieces only where they exceed a sequence; all
pieces but the first are then full. Full pieces are sequences by themselves. The others are
dealt to shards of bounded size. In a shard several islands search: an individual is a set of
bins; crossover puts whole well-filled bins of one parent into the other, removes the bins that
hold the same pieces a second time, and places the displaced pieces by best fit. After each
round every island passes its best individual on to its neighbour in the ring, and in the end
the best island's bins count.

Null and empty texts are one piece with the end id alone. Repeated rows and ids are packed once
per row. An empty table gives an empty result. Further columns stay behind. Texts are taken
whole. Sequence ids are any numbers; offsets are gapless from 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.bpe import encode_batches
from textwarden.llm.common import cut_lineage, documents

#: Pieces of a shard, islands of a shard, rounds between migrations, and work within a round.
SHARD = 1 << 13
ISLANDS = 3
ROUNDS = 2
POPULATION = 4
GENERATIONS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """`doc_id`, `piece`, `start`, `length`, `ids_crc32` of each piece of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, places in encode_batches(path, batches):
            counts = np.diff(places) + 1
            raw = np.insert(ids.astype("<u4"), places[1:], end_id)
            begins = np.cumsum(counts) - counts
            number = -(-counts // size)
            row = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            first = (counts - 1) % size + 1
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            length = np.where(piece == 0, first[row], size)
            at = begins[row] + start
            crc = [zlib.crc32(raw[a:a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, PIECES)


class Bins:
    """Bins under construction; the fullest one that still has room is found by a bit mask of free spaces."""

    def __init__(self, size: int):
        self.size, self.members, self.free = size, [], []
        self._by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self._mask = 0

    def add(self, members: list[int], used: int) -> None:
        """A bin with its members, as it is."""
        self.members.append(members)
        self.free.append(self.size - used)
        self._offer(len(self.members) - 1)

    def _offer(self, b: int) -> None:
        free = self.free[b]
        if free:
            self._by_free[free].append(b)
            self._mask |= 1 << free

    def place(self, item: int, length: int) -> None:
        """Best fit: into the bin that this leaves fullest, else into a new one."""
        room = self._mask >> length
        if not room:
            self.add([item], length)
            return
        free = length + (room & -room).bit_length() - 1
        b = self._by_free[free].pop()
        if not self._by_free[free]:
            self._mask &= ~(1 << free)
        self.members[b].append(item)
        self.free[b] = free - length
        self._offer(b)

    def cost(self) -> tuple[int, float]:
        """Fewer bins are better; of equally many, those with a few nearly empty ones."""
        used = self.size - np.array(self.free, np.float64)
        return len(self.free), -float((used * used).sum())

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for b, items in enumerate(self.members):
            out[items] = b
        return out


def from_assignment(assigned: np.ndarray, lengths: list[int], size: int) -> Bins:
    bins, order = Bins(size), np.argsort(assigned, kind="stable")
    cuts = np.flatnonzero(np.diff(assigned[order])) + 1
    for items in np.split(order, cuts) if len(order) else []:
        items = items.tolist()
        bins.add(items, sum(lengths[i] for i in items))
    return bins


def best_fit(order: np.ndarray, lengths: list[int], size: int) -> Bins:
    bins = Bins(size)
    for i in order.tolist():
        bins.place(i, lengths[i])
    return bins


def crossover(base: Bins, other: Bins, lengths: list[int], rng: np.random.Generator) -> Bins:
    """Bins of `other` that are (nearly) full are injected into `base`; displaced pieces go by best fit."""
    good = np.flatnonzero(np.array(other.free) <= np.quantile(other.free, 0.5))
    chosen = rng.permutation(good)[:max(1, len(good) // 2)]
    taken = np.zeros(len(lengths), bool)
    child = Bins(base.size)
    for b in chosen.tolist():
        taken[other.members[b]] = True
        child.add(list(other.members[b]), base.size - other.free[b])
    displaced = []
    worst = np.quantile(base.free, 0.98)
    for b, items in enumerate(base.members):
        if taken[items].any():
            displaced += [i for i in items if not taken[i]]
        elif base.free[b] and base.free[b] >= worst:  # mutation: the emptiest bins are dissolved
            displaced += items
        else:
            child.add(list(items), base.size - base.free[b])
    displaced.sort(key=lambda i: -lengths[i])
    for i in displaced:
        child.place(i, lengths[i])
    return child


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], size: int, rng: np.random.Generator) -> np.ndarray:
    """The best assignment after a round on one island; `seeds` are the individuals it starts with."""
    sizes = lengths.tolist()
    people = [from_assignment(s, sizes, size) for s in seeds]
    while len(people) < POPULATION:
        noise = rng.integers(0, 1 + size // 64 * len(people), len(lengths))
        people.append(best_fit(np.argsort(-(lengths + noise), kind="stable"), sizes, size))
    lower = -(-int(lengths.sum()) // size)
    people.sort(key=Bins.cost)
    for _ in range(GENERATIONS):
        if len(people[0].free) <= lower:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child = crossover(people[min(a, b)], people[max(a, b)], sizes, rng)
        people = sorted([*people, child], key=Bins.cost)[:POPULATION]
    return people[0].assignment(len(lengths))


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """`cut` (`doc_id`, `piece`, `start`, `length`, `ids_crc32`) with `sequence_id` and `offset`."""
    cut = cut_lineage(cut.withColumn("row", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") >= size).select(
        *cut.columns[:-1], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = cut.where(F.col("length") < size)
    shards = max(1, -(-small.count() // SHARD))
    small = small.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    items = small.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("items"))
    islands = items.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                           F.col("items.row").alias("rows"), F.col("items.length").alias("lengths"))
    state = cut_lineage(islands.withColumn("elites", F.array().cast("array<array<int>>")))
    for r in range(ROUNDS):
        state = _round(state, size, r)
        ring = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                            F.col("elites").alias("guests"))
        state = cut_lineage(state.join(ring, ["shard", "island"])
                            .withColumn("elites", F.concat("elites", "guests")).drop("guests"))
    return full.unionByName(_places(small, state, size))


def _round(state: DataFrame, size: int, r: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard, island, _, lengths, elites = (row.column(k)[0].as_py() for k in range(5))
                rng = np.random.default_rng([shard, island, r])
                best = evolve(np.array(lengths, np.int64), [np.array(e, np.int32) for e in elites], size, rng)
                out = pa.array([[best.tolist()]], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*row.columns[:4], out], row.schema.names)

    wide = state.repartition(F.col("shard"), F.col("island"))
    return cut_lineage(wide.mapInArrow(run, state.schema))


def _places(small: DataFrame, state: DataFrame, size: int) -> DataFrame:
    """Places of the pieces by the best individual of each shard."""
    bins = state.withColumn("best", F.expr("array_min(transform(elites, e -> struct(array_max(e) AS bins, e AS e)))"))
    best = bins.groupBy("shard").agg(F.min(F.struct("best.bins", "island", "rows", "best.e")).alias("b"))
    placed = (best.select("shard", F.explode(F.arrays_zip(F.col("b.rows").alias("row"), F.col("b.e").alias("bin"))).alias("x"))
              .select("shard", F.col("x.row").alias("row"), F.col("x.bin").alias("bin")))
    joined = small.join(placed, ["shard", "row"])
    sums = F.sum("length").over(_window())
    return joined.select(*[c for c in small.columns if c not in ("row", "shard")],
                         (F.col("shard").cast("long") * (SHARD * 1024) + F.col("bin")).alias("sequence_id"),
                         (sums - F.col("length")).alias("offset"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("shard", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
