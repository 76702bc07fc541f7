"""Exact removal of long repeats with a run-length index of the Burrows-Wheeler transform.

A byte is removed if it lies in a string of `length` bytes that also starts earlier: in a
document with a smaller id, or earlier in the same document.

Every window of `length` bytes belongs to one anchor: its least k-mer by hash. Equal windows
have equal anchors, so the stretch of text around an anchor (all its windows) goes to the bucket
of its k-mer, and each bucket decides its windows alone. There the stretches are indexed: rows
sorted by their first `length` bytes, ties by place, give a Burrows-Wheeler transform of bounded
order that is kept in runs, with the places of run ends as samples. The stretches' windows are
matched in it; those whose interval of rows begins at an earlier place have a long match.
Copies of a stretch take the matches of the first one, so repetitive corpora stay small.

Skew: a k-mer in a large share of the documents (found on a bounded sample, which only steers
where work goes) is taken as an anchor only where a window has no other one; equal stretches
within a batch of a task are sent once.

Null and empty texts lose nothing. A null id comes before all others. Rows that share id and text count as one document and each
get its row; rows that share only the id are ordered by their text's checksum. An empty table
gives an empty result. Further columns stay behind (`remove` keeps them). Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textwarden.llm.common import documents, flat, fresh, ranges, slices

LENGTH, KMER = 100, 16
#: Text of a slice and of a batch, stretches of a bucket, text of a group of documents, and an index, in bytes.
SLICE, BATCH, BUCKET, GROUP, INDEX = 1 << 20, 8 << 20, 12 << 20, 6 << 20, 1 << 20
#: Documents in the sample that finds frequent k-mers, and the share of them that makes one frequent.
SAMPLE, FREQUENT = 2000, 0.02
_LEVEL = 6
_BITS = 20
_NO_ID = -(1 << 63)
_PLACE = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("start", "<i8")])


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each place on (places near the end see zeros)."""
    padded = np.zeros(len(data) + KMER, np.uint64)
    padded[:len(data)] = data
    for step in (1, 2, 4):
        padded[:-step] |= padded[step:] << np.uint64(8 * step)
    with np.errstate(over="ignore"):
        h = padded[:len(data)] * np.uint64(0x9E3779B97F4A7C15) ^ (padded[8:len(data) + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray | None, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: document, start, number of windows, place and hash of the anchor."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    h = kmer_hashes(data)
    order = h >> np.uint64(33)
    if frequent is not None:
        order |= frequent[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(31)
    least = order << np.uint64(32) | np.arange(len(data), dtype=np.uint64)
    wide, size = length - KMER + 1, 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = wide - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    docs = np.repeat(np.arange(len(count)), count)
    start = ranges(offsets[:-1], count)
    if not len(start):
        return none
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (docs[1:] != docs[:-1])]))
    windows = np.diff(np.append(head, len(start)))
    return docs[head], start[head], windows, place[head], h[place[head]]


def range_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each range of `data`."""
    rng, out = np.random.default_rng(11), []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        numbers = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        powers, inverse = (np.full(len(data) + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        powers[0] = inverse[0] = 1
        powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(numbers[data] * powers[:len(data)], out=sums[1:])
        out.append((sums[starts + sizes] - sums[starts]) * inverse[starts] + sizes.astype(np.uint64))
    return out[0], out[1]


def packed(**arrays: np.ndarray) -> bytes:
    parts = [len(arrays).to_bytes(1, "little")]
    for name, a in arrays.items():
        head = f"{name}:{a.dtype.str}:{len(a)}".encode()
        parts += [len(head).to_bytes(1, "little"), head, np.ascontiguousarray(a).tobytes()]
    return zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(parts))


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = {}, 1
    for _ in range(raw[0]):
        n = raw[at]
        name, kind, size = raw[at + 1:at + 1 + n].decode().split(":")
        at += 1 + n
        out[name] = np.frombuffer(raw, np.dtype(kind), int(size), at)
        at += out[name].nbytes
    return out


def ranks_of(codes: np.ndarray, length: int) -> np.ndarray:
    """Places of `codes` in the order of their next `length` symbols, ties by place, and the rank of each place."""
    n = len(codes)
    index_bits = max(n - 1, 1).bit_length()
    symbol_bits = int(codes.max()).bit_length() or 1
    have = min(length, max(1, (63 - index_bits) // symbol_bits))
    key = np.zeros(n, np.uint64)
    for j in range(have):
        key <<= np.uint64(symbol_bits)
        key[:n - j] |= codes[j:].astype(np.uint64)
    wide = have * symbol_bits + index_bits <= 64
    while True:
        if wide:  # the place fits beside the key
            both = np.sort(key << np.uint64(index_bits) | np.arange(n, dtype=np.uint64))
            order = (both & np.uint64((1 << index_bits) - 1)).astype(np.int64)
            ordered = both >> np.uint64(index_bits)
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.uint64)
        rank[order] = new
        if have == length or new[-1] == n - 1:
            return order, new
        step = min(have, length - have)
        bits = int(new[-1] + 1).bit_length()
        after = np.zeros(n, np.uint64)
        after[:n - step] = rank[step:] + np.uint64(1)
        key = rank << np.uint64(bits) | after
        have += step
        wide = 2 * bits + index_bits <= 64


class RunIndex:
    """A Burrows-Wheeler transform of bounded order in runs, with the places at run ends.

    Row i stands for the place with the i-th smallest next `length` symbols. Rows that agree in all
    of them form an interval, in which places ascend.
    """

    def __init__(self, codes: np.ndarray, length: int):
        self.length = length
        order, rank = ranks_of(codes, length)
        symbols = codes[order - 1]  # the symbol before each row's place
        fresh = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (rank[1:] != rank[:-1])])
        self.head = np.flatnonzero(fresh)  # runs, cut at interval borders
        self.symbol = symbols[self.head]
        self.first_place = order[self.head]
        tail = np.append(self.head[1:], len(order)) - 1
        self.last_place = order[tail]
        self.interval = rank[self.head]
        self._order = order

    def statistics(self) -> np.ndarray:
        """For each place, an earlier place with the same next `length` symbols (-1: none).

        Runs are streamed in row order. All rows of an interval match its first place, which is
        the sample of its first run.
        """
        opens = np.concatenate([[True], self.interval[1:] != self.interval[:-1]])
        earliest = self.first_place[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        match = np.repeat(earliest, np.diff(np.append(self.head, len(self._order))))
        out = np.full(len(self._order), -1, np.int64)
        out[self._order] = np.where(match < self._order, match, -1)
        return out


def repeated_windows(text: np.ndarray, offsets: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For all windows of the stretches, in order: whether an earlier stretch or window of the group holds the same bytes."""
    out = np.zeros(int(windows.sum()), bool)
    first = np.cumsum(windows) - windows
    size = np.diff(offsets)
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(cuts[1:], len(group))
    at = 0
    while at < len(cuts):  # whole groups, up to a bounded index
        to = at + 1
        while to < len(cuts) and offsets[ends[to]] - offsets[cuts[at]] <= INDEX:
            to += 1
        a, b = cuts[at], ends[to - 1]
        table = np.zeros(256, np.int64)
        piece = text[offsets[a]:offsets[b]]
        used = np.unique(piece)
        table[used] = np.arange(1, len(used) + 1)
        spaced = np.zeros(len(piece) + b - a, np.int64)  # 0 ends each stretch
        begin = offsets[a:b] - offsets[a] + np.arange(b - a)
        spaced[ranges(begin, size[a:b])] = table[piece]
        match = RunIndex(spaced, length).statistics()
        out[first[a]:first[b - 1] + windows[b - 1]] = match[ranges(begin, windows[a:b])] >= 0
        at = to
    return out


def _local(parts: list, length: int, buckets: int, groups: int) -> Iterator[tuple[int, bytes]]:
    """Rows of a batch: each distinct stretch for its bucket, and for the documents' groups the windows already decided."""
    doc, tie, start, windows, offset, h, k1, k2, text = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(doc):
        return
    size = windows + length - 1
    at = np.cumsum(size) - size
    place = np.zeros(len(doc), _PLACE)
    place["doc"], place["tie"], place["start"] = doc, tie, start
    order = np.lexsort((start, tie, doc, k2, k1))
    same = np.concatenate([[False], (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])])
    first = np.flatnonzero(~same)
    owner = first[np.cumsum(~same) - 1]
    later = place[order] != place[order[owner]]
    yield from _results(place[order[same & later]], windows[order[same & later]], groups)
    keep = order[first]
    bucket = ((h[keep] & np.uint64((1 << 33) - 1)) % np.uint64(buckets)).astype(np.int64)
    keep, bucket = (x[np.lexsort((start[keep], doc[keep], bucket))] for x in (keep, bucket))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket)) if len(bucket) else [], strict=True):
        rows = keep[a:b]
        yield int(bucket[a]), packed(
            text=text[ranges(at[rows], size[rows])], doc=np.diff(doc[rows], prepend=0), tie=tie[rows].astype(np.uint32),
            start=start[rows], windows=windows[rows].astype(np.uint16), offset=offset[rows].astype(np.uint16))


def _results(place: np.ndarray, windows: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Repeated windows (place of the first, number) by group of documents; such groups have negative numbers."""
    group = group_of(place["doc"], groups)
    order = np.lexsort((place["start"], place["doc"], group))
    group, place, windows = group[order], place[order], windows[order]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(group)) if len(group) else [], strict=True):
        yield -1 - int(group[a]), packed(doc=np.diff(place["doc"][a:b], prepend=0), tie=place["tie"][a:b].astype(np.uint32),
                                         start=place["start"][a:b], windows=windows[a:b].astype(np.uint32))


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    mixed = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(31)) % np.uint64(groups)).astype(np.int64)


def checksums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint32)


def _stretches(docs: DataFrame, length: int, buckets: int, groups: int, frequent: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def rows() -> pa.RecordBatch:
            found = list(_local(parts, length, buckets, groups)) if parts else []
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["key", "blob"])

        for batch in slices(batches, SLICE):
            data, offsets = flat(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, start, windows, place, h = anchors(data, offsets, frequent, length)
            size = windows + length - 1
            keys = range_keys(data, start, size)
            parts.append((ids[doc], checksums(data, offsets)[doc], start - offsets[doc], windows, place - start, h, *keys, data[ranges(start, size)]))
            held += len(data)
            if held >= BATCH:
                yield rows()
                parts, held = [], 0
        yield rows()

    return docs.mapInArrow(run, "key long, blob binary")


def decide(blobs: list[bytes], length: int, groups: int) -> Iterator[tuple[int, bytes]]:
    """The repeated windows of a bucket."""
    parts = [unpacked(b) for b in blobs]
    doc = np.concatenate([np.cumsum(p["doc"]) for p in parts])
    tie, start, windows, offset, text = (np.concatenate([p[c] for p in parts]) for c in ("tie", "start", "windows", "offset", "text"))
    del parts
    windows = windows.astype(np.int64)
    size = windows + length - 1
    at = np.cumsum(size) - size
    anchor = at + offset
    h = np.zeros(len(at), np.uint64)
    for begin in range(0, len(at), 1 << 16):  # the anchors' k-mers, hashed again
        rows = anchor[begin:begin + (1 << 16)]
        grid = text[rows[:, None] + np.arange(KMER)].reshape(-1)
        h[begin:begin + (1 << 16)] = kmer_hashes(grid)[::KMER]
    order = np.lexsort((start, tie, doc, h))
    hs = h[order]
    twice = np.zeros(len(hs), bool)
    if len(hs) > 1:
        equal = hs[1:] == hs[:-1]
        twice[1:] |= equal
        twice[:-1] |= equal
    order = order[twice]
    if not len(order):
        return
    place = np.zeros(len(doc), _PLACE)
    place["doc"], place["tie"], place["start"] = doc, tie, start
    raw, known, chosen, copies = text.tobytes(), {}, [], []
    for i in order.tolist():  # in the order of places within a k-mer: the first copy of a stretch is the earliest
        own = raw[at[i]:at[i] + size[i]]
        first = known.setdefault(own, i)
        if first == i:
            chosen.append(i)
        elif place[first] != place[i]:
            copies.append(i)
    chosen = np.array(chosen)
    found = [(place[copies], windows[copies])] if copies else []
    sizes = size[chosen]
    flags = repeated_windows(text[ranges(at[chosen], sizes)], np.concatenate([[0], np.cumsum(sizes)]), windows[chosen], h[chosen], length)
    hit = np.flatnonzero(flags)
    if len(hit):
        owner = np.repeat(chosen, windows[chosen])[hit]
        inner = (np.arange(len(flags)) - np.repeat(np.cumsum(windows[chosen]) - windows[chosen], windows[chosen]))[hit]
        head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)])
        runs = np.flatnonzero(head)
        where = place[owner[runs]].copy()
        where["start"] += inner[runs]
        found.append((where, np.diff(np.append(runs, len(hit)))))
    for where, count in found:
        yield from _results(where, count, groups)


def _cover(blobs: list[bytes], length: int) -> dict[tuple[int, int], np.ndarray]:
    """Removed runs [start, end) of each document of a group."""
    parts = [unpacked(b) for b in blobs]
    if not parts:
        return {}
    doc = np.concatenate([np.cumsum(p["doc"]) for p in parts])
    tie, start, windows = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in ("tie", "start", "windows"))
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order]
    end = start + windows[order] + length - 1
    out = {}
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]))
    for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
        far = np.maximum.accumulate(end[a:b])
        head = np.flatnonzero(np.concatenate([[True], start[a + 1:b] > far[:-1]]))
        out[int(doc[a]), int(tie[a])] = np.stack([start[a:b][head], far[np.append(head[1:], b - a) - 1]], 1)
    return out


def frequent_kmers(docs: DataFrame, rows: int, length: int) -> np.ndarray:
    """Marks of the hash ends of k-mers that are anchors in a large share of a sample of documents."""
    every = max(1, rows // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            data, offsets = flat(batch.column(1))
            doc, _, _, _, h = anchors(data, offsets, None, length)
            pairs = np.unique(np.stack([doc.astype(np.uint64), h & np.uint64((1 << _BITS) - 1)], 1), axis=0)
            ends, n = np.unique(pairs[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ends.astype(np.int64)), pa.array(n)], ["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(every)) == 0)
    counted = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    marks = np.zeros(1 << _BITS, bool)
    marks[[r.h for r in counted.where(F.col("n") > max(2, FREQUENT * rows / every)).collect()]] = True  # at most 2 ** _BITS
    return marks


def _removals(docs: DataFrame, length: int) -> tuple[DataFrame, int]:
    """`key`, `blob` of repeated windows by group of documents, and the number of groups."""
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    spread = 1 + length / ((length - KMER + 2) / 2)
    buckets, groups = (max(1, int(-(-total * x // y))) for x, y in ((spread, BUCKET), (1, GROUP)))
    frequent = frequent_kmers(docs, rows, length)
    sent = _stretches(docs, length, buckets, groups, frequent)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blobs = frame["blob"].tolist()
        found = [(key[0], b) for b in blobs] if key[0] < 0 else list(decide(blobs, length, groups))
        return pd.DataFrame({"key": pd.Series([k for k, _ in found], dtype="int64"), "blob": pd.Series([b for _, b in found], dtype=object)})

    return sent.groupBy("key").applyInPandas(run, "key long, blob binary"), groups


def _apply(docs: DataFrame, length: int, schema: str | StructType, each) -> DataFrame:
    """`each` (Arrow table of rows of `docs`, their texts in bytes, their removed runs), by groups of documents."""
    plain = documents(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    removals, groups = _removals(plain, length)
    doc, group = fresh(docs.columns, "doc", "key")
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    keyed = keyed.withColumn(group, -1 - F.pmod(F.shiftrightunsigned(_times(F.col(doc)), 31), F.lit(groups)))

    def run(_: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        runs, none = _cover(found.column("blob").to_pylist(), length), np.zeros((0, 2), np.int64)
        raw = [t or b"" for t in texts.column("text").cast(pa.binary()).to_pylist()]
        own = [runs.get((d, zlib.crc32(t)), none) for d, t in zip(texts.column(doc).to_pylist(), raw, strict=True)]
        return each(texts.drop_columns([doc, group]), raw, own)

    return keyed.groupBy(group).cogroup(removals.groupBy("key")).applyInArrow(run, schema)


def _times(doc: F.col) -> F.col:
    """`doc` times the odd constant of `group_of`, modulo 2 ** 64, without overflow errors."""
    low = doc.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(doc, 32)
    a, b = 0x7F4A7C15, 0x9E3779B9
    # low * a may need 64 bits, so its parts are added by halves
    p = low.bitwiseAND(F.lit(0xFFFF)) * a
    q = F.shiftrightunsigned(low, 16) * a
    mid = F.shiftrightunsigned(p, 16) + q
    lower = F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(p.bitwiseAND(F.lit(0xFFFF)))
    carry = F.shiftrightunsigned(mid, 16)

    def short(x: F.col, c: int) -> F.col:  # x * c modulo 2 ** 32
        u = x.bitwiseAND(F.lit(0xFFFF)) * c
        v = (F.shiftrightunsigned(x, 16) * c).bitwiseAND(F.lit(0xFFFF))
        return (u + F.shiftleft(v, 16)).bitwiseAND(F.lit(0xFFFFFFFF))

    upper = (carry + short(low, b) + short(high, a)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(upper, 32).bitwiseOR(lower)


def kept_bytes(raw: bytes, runs: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, b in runs.tolist():
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`."""
    def each(rows: pa.Table, raw: list[bytes], runs: list[np.ndarray]) -> pa.Table:
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_bytes": pa.array([len(t) for t in raw], pa.int64()),
            "n_removed": pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
            "n_spans": pa.array([len(r) for r in runs], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(raw, runs, strict=True)], pa.string())})

    return _apply(documents(docs), length, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", each)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` without the repeated bytes; characters cut in two go as well. Texts that lose everything are dropped."""
    def each(rows: pa.Table, raw: list[bytes], runs: list[np.ndarray]) -> pa.Table:
        at = rows.column_names.index("text")
        old = rows.column("text").to_pylist()
        new = [kept_bytes(t, r).decode("utf-8", "ignore") if len(r) else o for t, r, o in zip(raw, runs, old, strict=True)]
        gone = np.array([bool(len(r)) and not n for r, n in zip(runs, new, strict=True)], bool)
        return rows.set_column(at, rows.field(at), pa.array(new, rows.field(at).type)).filter(pa.array(~gone))

    return _apply(docs, length, docs.schema, each)
