"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task holds decoded at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder that the cluster names and read back from there.

    A folder of our own is taken only where none is set and the session is local, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textwarden-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """`doc_id` and `text` (null text: empty); further columns stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that differ from all that are taken."""
    used, mark = {c.lower() for c in taken}, "_"
    while any(mark + n in used for n in names):
        mark += "_"
    return [mark + n for n in names]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a text column as one run of bytes, and the offset of each value in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES,
           column: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches cut where `column` reaches `size` bytes; a longer text comes alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each range of `data` (ascending, apart), equal for equal bytes, and the bytes of each number.

    What lies between two ranges is numbered too, but given to none.
    """
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[::2], bounds[1::2] = starts, ends
    if len(starts) > 1 and (ends[:-1] == starts[1:]).all():
        bounds = np.append(starts, ends[-1]).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), max(len(bounds) - 1, 0), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    numbers = numbers if len(bounds) == len(starts) + 1 else numbers[::2]
    used, numbers = np.unique(numbers, return_inverse=True)
    return numbers, coded.dictionary.take(pa.array(used))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges `start .. start + length - 1`, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - begin, lengths)
