"""Frequent phrases that are more than their parts, found by Rabin-Karp fingerprints.

Texts are packed into compressed slices first, which all passes read. Each task hashes the words of
a slice with prefix polynomials, and every n-gram as a difference of two prefixes over the words'
numbers. Equal n-grams of a slice are counted before the shuffle; fingerprints meet in buckets of bounded size. A first pass counts words and pairs. The
second sends fingerprints with a pointer to one occurrence in the slice, for words and pairs that
were frequent and longer phrases whose neighbours all were. That is tested with bitmaps of at most
`MAP_BITS` bits together, however many pairs there are: they let some rare phrases through and
never stop a frequent one. The pointers of frequent fingerprints go back to their slices, and the
phrases that are read there are counted by their words. So no two phrases are mixed up whatever
the hash does.

Null texts are empty, a null language is `und`. Repeated rows count as often as they occur. Empty
tables and texts give no rows. Ties are ordered as `phrases` says. Other columns stay behind. A
text is one unit of work: about 60 times its bytes are held while its n-grams are counted.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import cut_lineage, distinct, flat, slices

#: What ends a piece, and what parts words (fixed values).
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Text whose n-grams are counted at a time, text that a bucket of fingerprints stands for, and text in
#: which one task reads phrases.
SLICE_BYTES, BUCKET_BYTES, READ_BYTES = 5 << 20, 12 << 20, 128 << 20
#: Bits of a fingerprint; more bits mean fewer rare phrases that are read in vain, results are the same.
PRINT_BITS = 48
#: The bitmaps of frequent pairs hold at most so many bits together (64 MB are broadcast at most).
MAP_BITS = 1 << 29
#: Parts of a language whose best phrases are ranked before all are.
SHARDS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_COUNT = np.dtype([("print", "<u8"), ("count", "<u4")])
_ENTRY = np.dtype([("print", "<u8"), ("count", "<u4"), ("n", "u1"), ("at", "<u4")])
#: A phrase of `n` words in a slice, by the number of its first word there.
_POINTER = np.dtype([("n", "u1"), ("at", "<u4"), ("count", "<u4")])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2


def _squeeze(rows: np.ndarray) -> bytes:
    """Records as compressed planes of bytes."""
    planes = rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.copy()
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _spread(data: bytes, count: int, kind: np.dtype) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=count * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, count).T.copy().view(kind).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _polynomials(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of `values[i] * base**i` modulo 2**64, and the inverse powers."""
    def powers(base: np.uint64) -> np.ndarray:
        out = np.full(len(values) + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE)[:-1], out=sums[1:])
    return sums, powers(_INVERSE)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts in `data` start and end."""
    word = _KIND[data] == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    return np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


class Words:
    """The words of the texts in `data`: places, pieces, exact numbers within the slice, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end = word_bounds(data, offsets)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.piece = np.cumsum(_KIND[data] == 2)[self.start] + self.doc
        if not len(self.start):
            self.id, self.hash = np.zeros(0, np.int32), np.zeros(0, np.uint64)
            return
        self.id, names = distinct(data, self.start, self.end)
        letters, at = flat(names)
        sums, inverse = _polynomials(letters.astype(np.uint64) + np.uint64(1))
        own = _mix((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]])
        self.hash = own[self.id]

    def prints(self, sizes: tuple[int, ...], salt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size the places of all n-grams within pieces, and their fingerprints."""
        sums, inverse = _polynomials(self.hash)
        for n in sizes:
            at = np.arange(max(len(self.start) - n + 1, 0))
            at = at[self.piece[at] == self.piece[at + n - 1]]
            whole = _mix((sums[at + n] - sums[at]) * inverse[at] + salt[self.doc[at]] * np.uint64(2 * n + 1))
            yield n, at, whole >> np.uint64(64 - PRINT_BITS)


def _salts(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _bucket(prints: np.ndarray, buckets: int) -> np.ndarray:
    return ((prints >> np.uint64(PRINT_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class PrintMap:
    """Bitmaps, one for each bucket of fingerprints, of the words and pairs that are frequent."""

    def __init__(self, maps: dict[int, bytes], buckets: int):
        sizes = np.array([max(len(maps.get(b, b"")), 8) for b in range(buckets)], np.int64)
        self.first, self.buckets = np.cumsum(sizes) - sizes, buckets
        self.mask = (sizes * 8 - 1).astype(np.uint64)
        self.bits = np.frombuffer(b"".join(maps.get(b, bytes(8)) for b in range(buckets)), np.uint8)

    @staticmethod
    def build(prints: np.ndarray, buckets: int) -> bytes:
        bits = min(1 << max(6, int(16 * len(prints)).bit_length()), max(64, 1 << (MAP_BITS // buckets).bit_length() - 1))
        out = np.zeros(bits, np.uint8)
        for place in PrintMap._places(prints, np.uint64(bits - 1)):
            out[place] = 1
        return np.packbits(out, bitorder="little").tobytes()

    @staticmethod
    def _places(prints: np.ndarray, mask: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
        yield (prints & mask).astype(np.int64)
        yield (_mix(prints) & mask).astype(np.int64)

    def holds(self, prints: np.ndarray) -> np.ndarray:
        bucket = _bucket(prints, self.buckets)
        out = np.ones(len(prints), bool)
        for place in self._places(prints, self.mask[bucket]):
            out &= (self.bits[self.first[bucket] + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _count(words: Words, n: int, at: np.ndarray, prints: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """One record for each different n-gram; equal fingerprints of different words stay apart."""
    found = []
    while len(at):
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.diff(np.append(first, len(ordered)))
        place = at[order]
        lead = place[first]
        like = np.repeat(lead, sizes)
        same = lang[words.doc[place]] == lang[words.doc[like]]
        for k in range(n):
            same &= words.id[place + k] == words.id[like + k]
        rows = np.zeros(len(first), _ENTRY)
        rows["print"], rows["count"], rows["n"] = ordered[first], np.add.reduceat(same.astype(np.int64), first), n
        rows["at"] = lead
        found.append(rows)
        at, prints = place[~same], ordered[~same]
    return np.concatenate(found) if found else np.zeros(0, _ENTRY)


def _in_buckets(rows: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = _bucket(rows["print"], buckets)
    order = np.lexsort((rows["print"], bucket))
    rows = rows[order]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    yield from ((b, rows[cuts[b]:cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist())


def _packed(docs: DataFrame) -> DataFrame:
    """Slices of texts, ASCII letters in lower case, each compressed in one row with a number of its own."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("size", pa.int64()), ("texts", pa.binary()),
                        ("offsets", pa.binary()), ("langs", pa.list_(pa.string())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, SLICE_BYTES):
            raw, offsets = flat(batch.column(batch.schema.get_field_index("text")))
            langs = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
            codes = langs.indices.to_numpy().astype("<i4")
            yield pa.RecordBatch.from_pylist([{
                "id": number, "n": batch.num_rows, "size": len(raw),
                "texts": pa.compress(_LOWER[raw].tobytes(), codec="zstd", asbytes=True),
                "offsets": _squeeze(offsets.astype("<i8")), "langs": langs.dictionary.to_pylist(),
                "codes": _squeeze(codes)}], schema=schema)
            number += 1

    return docs.mapInArrow(run, "id long, n int, size long, texts binary, offsets binary, langs array<string>, codes binary")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The bytes of a slice, the places of its texts, its languages, and the language of each text."""
    data = np.frombuffer(pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True), np.uint8)
    offsets = _spread(row["offsets"], row["n"] + 1, np.dtype("<i8"))
    return data, offsets, row["langs"], _spread(row["codes"], row["n"], np.dtype("<i4"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Words, list[str], np.ndarray, np.ndarray]]:
    """Of each slice its number, its words, its languages, the language and the salt of each text."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            data, offsets, langs, codes = _unpacked(row)
            yield row["id"], Words(data, offsets), langs, codes, _salts(langs)[codes]


def _tally(packed: DataFrame, buckets: int) -> DataFrame:
    """By bucket, the counts of the words and pairs of each slice; the words of each language beside."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("lang", pa.string()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, langs, codes, salt in _slices(batches):
            found = []
            for _, _, prints in words.prints((1, 2), salt):
                values, counts = np.unique(prints, return_counts=True)
                rows = np.empty(len(values), _COUNT)
                rows["print"], rows["count"] = values, counts
                found.append(rows)
            out = [(b, len(rows), _squeeze(rows), None, None) for b, rows in _in_buckets(np.concatenate(found), buckets)]
            tally = np.bincount(codes[words.doc], minlength=len(langs))
            out += [(int(x % np.uint64(buckets)), 0, None, lang, int(n)) for x, lang, n in zip(_salts(langs), langs, tally, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return packed.mapInArrow(run, "bucket int, n int, rows binary, lang string, words long")


def _joined(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by fingerprint, where each fingerprint starts, and whether it is frequent."""
    rows = rows[np.argsort(rows["print"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], rows["print"][1:] != rows["print"][:-1]]))
    return rows, first, np.add.reduceat(rows["count"].astype(np.int64), first) >= least


def _maps(tallies: DataFrame, least: int, buckets: int) -> DataFrame:
    """The map of the frequent fingerprints of each bucket; the words of each language beside."""
    schema = pa.schema([("bucket", pa.int32()), ("map", pa.binary()), ("lang", pa.string()), ("words", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        words: Counter = Counter()
        for x, n in zip(table["lang"].to_pylist(), table["words"].to_pylist(), strict=True):
            if x is not None:
                words[x] += n
        out = [(None, None, x, n) for x, n in words.items()]
        parts = [_spread(x, n, _COUNT) for x, n in zip(table["rows"].to_pylist(), table["n"].to_pylist(), strict=True) if n]
        if parts:
            rows, first, often = _joined(np.concatenate(parts), least)
            if often.any():
                out.append((key[0].as_py(), PrintMap.build(rows["print"][first[often]], buckets), None, None))
        return pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return tallies.groupBy("bucket").applyInArrow(run, "bucket int, map binary, lang string, words long")


def _pointers(packed: DataFrame, longest: int, buckets: int, maps: object) -> DataFrame:
    """By bucket, the n-grams of each slice that may be frequent: fingerprints, counts, pointers."""
    schema = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("rows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PrintMap(maps.value, buckets)
        for number, words, _, codes, salt in _slices(batches):
            pair = np.zeros(len(words.start) + longest, bool)
            found = []
            for n, at, prints in words.prints(tuple(range(1, longest + 1)), salt):
                if n <= 2:
                    keep = known.holds(prints)
                    if n == 2:
                        pair[at] = keep
                else:
                    keep = np.logical_and.reduce([pair[at + k] for k in range(n - 1)])
                found.append(_count(words, n, at[keep], prints[keep], codes))
            out = [(b, number, len(rows), _squeeze(rows)) for b, rows in _in_buckets(np.concatenate(found), buckets)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return packed.mapInArrow(run, "bucket int, id long, n int, rows binary")


def _frequent(tallies: DataFrame, least: int) -> DataFrame:
    """By slice, the pointers to its n-grams with frequent fingerprints."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("pointers", pa.binary())])

    def run(_: tuple, table: pa.Table) -> pa.Table:
        ids, sizes = table["id"].to_numpy(), table["n"].to_numpy()
        rows = np.concatenate([_spread(x, n, _ENTRY) for x, n in zip(table["rows"].to_pylist(), sizes, strict=True)])
        order = np.argsort(rows["print"], kind="stable")
        rows, first, often = _joined(rows, least)
        keep = np.repeat(often, np.diff(np.append(first, len(rows))))
        rows, source = rows[keep], np.repeat(np.arange(len(ids)), sizes)[order[keep]]
        order = np.lexsort((rows["at"], source))
        rows, source = rows[order], source[order]
        pointers = np.empty(len(rows), _POINTER)
        for name in _POINTER.names:
            pointers[name] = rows[name]
        used, first = np.unique(source, return_index=True)
        ends = np.append(first[1:], len(rows))
        return pa.Table.from_arrays([pa.array(ids[used]), pa.array(ends - first, pa.int32()), pa.array(
            [_squeeze(pointers[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary())], schema=schema)

    return tallies.groupBy("bucket").applyInArrow(run, "id long, n int, pointers binary")


def _read(packed: DataFrame, pointers: DataFrame, tasks: int) -> DataFrame:
    """The phrases that pointers show, read in their slices, with partial counts. Few tasks with many
    slices each leave few partial counts of a phrase to be shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data, offsets, langs, codes = _unpacked(row)
                raw, (start, end) = data.tobytes(), word_bounds(data, offsets)
                found: Counter = Counter()
                for part in row["parts"]:
                    rows = _spread(part["pointers"], part["n"], _POINTER)
                    at, n = rows["at"].astype(np.int64), rows["n"]
                    lang = codes[np.searchsorted(offsets, start[at], "right") - 1]
                    for code, n, a, b, count in zip(lang.tolist(), n.tolist(), start[at].tolist(),
                                                    end[at + n - 1].tolist(), rows["count"].tolist(), strict=True):
                        phrase = raw[a:b]
                        if n > 1 and phrase.count(b" ") != n - 1 or b"\t" in phrase:
                            phrase = b" ".join(x for x in phrase.replace(b"\t", b" ").split(b" ") if x)
                        found[code, n, phrase] += count
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[c] for c, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int32()),
                     pa.array([x for _, _, x in found], pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["lang", "n_words", "phrase", "part"])

    wanted = pointers.repartition(tasks, "id").groupBy("id").agg(F.collect_list(F.struct("n", "pointers")).alias("parts"))
    return packed.repartition(tasks, "id").join(wanted, "id").mapInArrow(run, "lang string, n_words int, phrase string, part long")


def counts(documents: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words that occur `least` times in a language, with their counts
    (`lang, n_words, phrase, f`), and the number of words of each language (`lang, n`)."""
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                            F.col("text").cast("string").alias("text")).where("octet_length(text) > 0")
    packed = cut_lineage(_packed(docs))
    size = packed.agg(F.sum("size")).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), 1)
    found = cut_lineage(_maps(_tally(packed, buckets), least, buckets))
    maps = {r.bucket: bytes(r.map) for r in found.where("map IS NOT NULL").select("bucket", "map").collect()}
    context = documents.sparkSession.sparkContext
    pointers = _frequent(_pointers(packed, longest, buckets, context.broadcast(maps)), least)
    tasks = max(-(-size // READ_BYTES), context.defaultParallelism)
    phrases = (_read(packed, pointers, tasks).groupBy("lang", "n_words", "phrase")
               .agg(F.sum("part").alias("f")).where(F.col("f") >= least))
    return cut_lineage(phrases), found.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("words").alias("n"))


def _parts(of: DataFrame, sizes: str) -> DataFrame:
    """Each phrase with the contiguous parts of it that have one of `sizes` words."""
    return (of.withColumn("words", F.split("phrase", " "))
            .withColumn("size", F.explode(F.expr(sizes)))
            .withColumn("first", F.explode(F.expr("sequence(1, n_words - size + 1)")))
            .withColumn("part", F.expr("array_join(slice(words, first, size), ' ')")))


def phrases(documents: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000) -> DataFrame:
    """The `top` phrases of each language: `lang, rank, phrase, a, l, r, n, score`.

    `a` counts the phrase, `l` and `r` the two parts of its weakest cut, and the score is
    `floor(2000000 a / (l + r))`, in decimal numbers, so exact. A phrase that lies within a longer
    frequent phrase with at least `share` percent of its count is dropped. Ranks go by score and `a`
    (both from high to low), then by the phrase's bytes.
    """
    all_counts, words = counts(documents, least, longest)
    candidates = all_counts.where("n_words > 1")
    wide = F.col("f").cast("decimal(20,0)")
    longer = (_parts(candidates.where("n_words > 2"), "sequence(2, n_words - 1)")
              .groupBy("lang", F.col("part").alias("phrase")).agg(F.max("f").alias("longest")))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest").cast("decimal(20,0)") * 100 < wide * share))
    cuts = _parts(kept, "sequence(1, n_words - 1)").where("first = 1 OR first + size = n_words + 1")
    one = all_counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = cuts.join(one, ["lang", "part"]).withColumn("k", F.expr(  # a part at the left end ends the cut, one at the right end starts after it
        "CASE WHEN first = 1 THEN size ELSE n_words - size END"))
    cuts = cuts.groupBy("lang", "phrase", "f", "k").agg(
        F.max(F.when(F.col("first") == 1, F.col("part_f"))).alias("l"),
        F.max(F.when(F.col("first") > 1, F.col("part_f"))).alias("r"))
    score = F.expr("(2000000 * CAST(f AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", F.col("f").alias("a"))
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = F.desc("score"), F.desc("a"), "phrase"
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))  # so the last ranking sees a bounded number of rows
    for by in (("lang", shard), ("lang",)):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return (scored.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
WITH lists AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents WHERE text IS NOT NULL)),
grams AS (
    SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
          FROM lists, (VALUES (1), (2), (3), (4)) s(size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS words FROM f WHERE f >= 30),
parts AS (
    SELECT lang, f, array_to_string(words[i:i + part - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - part + 2)) AS i
          FROM often, (VALUES (2), (3)) p(part) WHERE part < size)),
longest AS (SELECT lang, phrase, max(f) AS most FROM parts GROUP BY ALL),
kept AS (SELECT o.* FROM often o LEFT JOIN longest USING (lang, phrase)
         WHERE size > 1 AND (most IS NULL OR 100 * most < 80 * f)),
cuts AS (
    SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
    SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f::HUGEINT + t.f))::BIGINT AS score
    FROM cuts c JOIN often h ON h.lang = c.lang AND h.phrase = head JOIN often t ON t.lang = c.lang AND t.phrase = tail
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN n USING (lang) QUALIFY rank <= 2000
"""
