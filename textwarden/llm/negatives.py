"""Hard negatives by exact scores from subset-sum tables (the method of the Four Russians).

Components are whole numbers. For each anchor and each group of eight dimensions a table holds the
sums of the anchor's components over all 256 subsets. A candidate is packed into bit planes: one
byte for each group and binary digit, the sign digit last. Its score is the sum of the looked-up
entries, shifted by their digit. All rows are scored against all anchors, block by block: anchors
are dealt into groups and packed candidates into others, and each pair of groups is one task of
bounded size. The first pass finds each anchor's positives, the second its negatives.

Rows with a null label, a null vector or a component that is null or not finite take no part.
Equal scores go by the smaller `vec_id`, a null one last; a null `vec_id` is no anchor. Equal rows
count as often as they occur; of an anchor's own copies one is the anchor itself. Vectors of unequal
length are filled up with zeros. Empty tables give no rows; other columns stay behind. Scores must
fit 64 bits: a task that cannot rule out a larger one raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import cut_lineage

#: Candidates in a packed block and in a task, anchors in a task, anchors and candidates scored at a time.
BLOCK, CELL_ROWS, CELL_ANCHORS, LANES, STRIP = 1024, 65536, 1024, 64, 4096


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """`vec_id`, `label` and whole `numbers`: the components times `scale`, rounded down."""
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                           F.col("embedding").cast("array<double>").alias("embedding"))
            .where("label IS NOT NULL AND embedding IS NOT NULL AND "
                   "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
            .select("vec_id", "label", F.expr(f"transform(embedding, x -> floor({scale} * x))").alias("numbers")))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(max(sizes, default=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes `[digit, group, row]` of whole numbers in two's complement; the last is the sign."""
    n, d = numbers.shape
    digits = int(np.maximum(numbers, ~numbers).max(initial=0)).bit_length() + 1
    wide = np.zeros((n, -(-d // 8) * 8), np.int64)
    wide[:, :d] = numbers
    return np.stack([np.packbits((wide >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(digits)])


def subset_sums(anchors: np.ndarray, groups: int) -> np.ndarray:
    """Tables `[group, subset, anchor]` of the sums of components over every subset of eight dimensions."""
    n, d = anchors.shape
    wide = np.zeros((groups * 8, n), anchors.dtype)
    wide[:d] = anchors.T
    out = np.zeros((groups, 256, n), anchors.dtype)
    for g in range(groups):
        for j in range(8):
            out[g, 1 << j:2 << j] = out[g, :1 << j] + wide[8 * g + j]
    return out


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inner products `[row, anchor]` of the packed rows with the tables' anchors."""
    out = np.zeros((bits.shape[2], tables.shape[2]), tables.dtype)
    for b in reversed(range(len(bits))):
        out += out
        for g in range(len(tables)):
            part = tables[g][bits[b, g]]
            if b == len(bits) - 1:
                out -= part
            else:
                out += part
    return out


def first(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` largest values, largest first; of equal ones the earlier place first."""
    if len(values) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        better = np.flatnonzero(values > least)
        at = np.concatenate([better, np.flatnonzero(values == least)[:k - len(better)]])
    else:
        at = np.arange(len(values))
    return at[np.lexsort((at, -values[at].astype(np.int64)))]


class Cell:
    """The candidates of one task, ordered by id, and their scores with its anchors."""

    def __init__(self, blocks: pa.Table):
        parts = [(np.frombuffer(ids, np.int64), np.frombuffer(none, bool), np.frombuffer(labels, np.int32),
                  np.frombuffer(bits, np.uint8).reshape(digits, groups, -1), most)
                 for ids, none, labels, bits, digits, groups, most in zip(
                     *(blocks[c].to_pylist() for c in ("ids", "none", "labels", "bits", "digits", "groups", "most")), strict=True)]
        digits, self.groups = max(p[3].shape[0] for p in parts), max(p[3].shape[1] for p in parts)
        ids, none = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, none))
        self.ids, self.none, self.labels = ids[order], none[order], np.concatenate([p[2] for p in parts])[order]
        self.bits = np.zeros((digits, self.groups, len(ids)), np.uint8)
        at = 0
        for _, _, _, bits, _ in parts:
            to = at + bits.shape[2]
            self.bits[:len(bits), :bits.shape[1], at:to] = bits
            self.bits[len(bits):, :bits.shape[1], at:to] = bits[-1]  # the sign digit goes on
            at = to
        self.bits = self.bits[:, :, order]
        self.most = max(p[4] for p in parts)

    def scored(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each anchor's place and its scores with all candidates."""
        bound = 8 * self.groups * self.most * int(np.abs(numbers).max(initial=0))
        if bound >= 1 << 63:
            raise ValueError("scores may pass 64 bits: scale the vectors down")
        numbers = numbers[:, :8 * self.groups].astype(np.int32 if bound < 1 << 31 else np.int64)
        for a in range(0, len(numbers), LANES):
            tables = subset_sums(numbers[a:a + LANES], self.groups)
            out = np.empty((tables.shape[2], len(self.ids)), tables.dtype)
            for b in range(0, len(self.ids), STRIP):
                out[:, b:b + STRIP] = scores(tables, self.bits[:, :, b:b + STRIP]).T
            yield from ((a + i, row) for i, row in enumerate(out))

    def id(self, at: int) -> int | None:
        return None if self.none[at] else int(self.ids[at])


def _packed(rows: DataFrame, cells: int) -> DataFrame:
    """Candidates as packed blocks, dealt to `cells` groups by turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                numbers = _matrix(part.column(2))
                if not numbers.shape[1]:
                    numbers = np.zeros((len(numbers), 8), np.int64)
                bits = planes(numbers)
                ids = part.column(0)
                yield pa.RecordBatch.from_pylist([{
                    "q": at % cells, "ids": ids.fill_null(0).to_numpy().tobytes(),
                    "none": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                    "labels": part.column(1).to_numpy().astype(np.int32).tobytes(), "bits": bits.tobytes(),
                    "digits": bits.shape[0], "groups": bits.shape[1],
                    "most": int(np.maximum(numbers, ~numbers).max(initial=0)) + 1}], schema=schema)
                at += 1

    schema = pa.schema([("q", pa.int32()), ("ids", pa.binary()), ("none", pa.binary()), ("labels", pa.binary()),
                        ("bits", pa.binary()), ("digits", pa.int32()), ("groups", pa.int32()), ("most", pa.int64())])
    return rows.select("vec_id", "label", "numbers").mapInArrow(
        run, "q int, ids binary, none binary, labels binary, bits binary, digits int, groups int, most long")


def _paired(anchors: DataFrame, blocks: DataFrame, sides: tuple[int, int], schema: str,
            pick: Callable[[Cell, dict, np.ndarray], list[tuple]]) -> DataFrame:
    """What `pick` takes from each anchor's scores with the candidates of each group."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def run(some: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and blocks.num_rows:
            cell, numbers = Cell(blocks), _matrix(some["numbers"])
            rows = some.drop_columns(["numbers"]).to_pylist()
            for at, row in cell.scored(numbers):
                out += pick(cell, rows[at], row)
        return pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    p, q = sides
    left = (anchors.withColumn("p", F.expr(f"pmod(xxhash64(key), {p})"))
            .withColumn("q", F.explode(F.expr(f"sequence(0, {q - 1})"))))
    right = blocks.withColumn("p", F.explode(F.expr(f"sequence(0L, {p - 1}L)")))
    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """Hard negatives for rows (`vec_id, label, numbers`) of which those with `anchor` are anchors.

    An anchor's positives are its `positives` best other rows of its label. For each of them come the
    `negatives` best rows of other labels that score at least `low` percent of the positive and no
    more than it: `anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.
    """
    anchors = cut_lineage(
        rows.where(anchor).withColumn("key", F.sha2(F.concat_ws(",", "vec_id", "label", F.col("numbers").cast("string")), 256))
        .groupBy("key", "vec_id", "label", "numbers").agg(F.count("*").alias("copies"))
        .withColumn("self", F.expr("aggregate(numbers, 0L, (s, x) -> try_add(s, try_multiply(x, x)))")))
    n_anchors, n_rows = anchors.count(), rows.count()
    p = max(-(-n_anchors // CELL_ANCHORS), 1)
    sides = p, max(-(-n_rows // CELL_ROWS), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // p))
    blocks = cut_lineage(_packed(rows, sides[1]))

    def same(cell: Cell, row: dict, values: np.ndarray) -> list[tuple]:
        own = np.flatnonzero(cell.labels == row["label"])
        return [(row["key"], cell.id(i), int(values[i])) for i in own[first(values[own], positives + 1)]]

    by_score = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = (_paired(anchors.select("key", "label", "numbers"), blocks, sides, "key string, id long, score long", same)
            .withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives + 1)
            .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("best")))
    with_best = (anchors.join(best, "key")
                 .withColumn("own", F.expr("array_position(transform(best, x -> x.id <=> vec_id AND x.score = self), true)"))
                 .withColumn("best", F.expr(f"slice(filter(best, (x, i) -> i + 1 <> own), 1, {positives})")))
    with_best = cut_lineage(with_best.select("key", "vec_id", "label", "numbers", "copies", "best"))

    def other(cell: Cell, row: dict, values: np.ndarray) -> list[tuple]:
        out = []
        bounds = [(-(-low * x["score"] // 100), x["score"]) for x in row["best"]]
        if not bounds:
            return out
        near = np.flatnonzero((values >= min(b[0] for b in bounds)) & (values <= max(b[1] for b in bounds))
                              & (cell.labels != row["label"]))
        for k, (least, most) in enumerate(bounds):
            fits = near[(values[near] >= least) & (values[near] <= most)]
            out += [(row["key"], k, cell.id(i), int(values[i])) for i in fits[first(values[fits], negatives)]]
        return out

    by_positive = Window.partitionBy("key", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = (_paired(with_best.select("key", "label", "numbers", "best"), blocks, sides,
                     "key string, k int, negative_id long, negative_score long", other)
             .withColumn("rank", F.row_number().over(by_positive)).where(F.col("rank") <= negatives))
    return (found.join(with_best.select("key", "vec_id", "best", "copies"), "key")
            .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
            .select(F.col("vec_id").alias("anchor_id"), F.expr("best[k].id").alias("positive_id"), "rank", "negative_id",
                    F.expr("best[k].score").alias("positive_score"), "negative_score"))


ORACLE_SQL = """
WITH given AS (
    SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS numbers
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.row_id, a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label,
           CAST(list_dot_product(a.numbers, b.numbers) AS BIGINT) AS score
    FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.row_id <> b.row_id),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, id) AS k
    FROM scored WHERE label = own QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.row_id, p.k ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.row_id = p.row_id AND s.label <> p.own
 AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""
