"""Document fingerprints that add up: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line) hashes to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, each component modulo 2^32. So the order of paragraphs does not matter,
and paragraphs are put in or taken out by adding or subtracting vectors (`combine`). The vector
has two parts: hash words of the whole paragraph, for equality, and counts of set hash bits over
the paragraph's runs of four words, whose signs estimate how much two documents share.

Null texts count as empty; an empty text is one empty paragraph. Repeated rows and ids each
give a row. Documents follow one another by ascending id (null ids first, equal ids by text),
the last is followed by the first; a single document follows itself. An empty table gives an
empty result. Further columns stay behind. Texts are taken whole. All work is DataFrame
expressions; documents are dealt once, in blocks of neighbours, whatever their ids look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import documents

#: Documents that a block of neighbours holds on average, and quantiles of the ids between which blocks are cut.
BLOCK, QUANTILES = 1024, 256
#: 32-bit words of the part for equality, and counters of the part for likeness.
WORDS, COUNTERS = 8, 64
_MASK = 0xFFFFFFFF
_UNITS = r"[^\s]+(?:\s+[^\s]+){0,3}"


def sums(texts: DataFrame, keys: list[str], text: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """`keys`, `carry` and `fp` (array of longs) of each text; `keys` must be unique."""
    lines = texts.select(*keys, *carry, F.explode(F.split(text, "\n", -1)).alias("line"))
    units = lines.select(*keys, *carry, "line",
                         F.posexplode_outer(F.regexp_extract_all("line", F.lit(_UNITS), F.lit(0))).alias("at", "unit"))
    first = F.coalesce("at", F.lit(0)) == 0
    aggregates = []
    for k in range(WORDS // 2):
        value = F.when(first, F.xxhash64(F.lit(k), "line"))
        aggregates += [F.coalesce(F.sum(value.bitwiseAND(F.lit(_MASK))), F.lit(0)).alias(f"w{2 * k}"),
                       F.coalesce(F.sum(F.shiftrightunsigned(value, 32)), F.lit(0)).alias(f"w{2 * k + 1}")]
    lanes = F.lit(0x0000000100000001)
    for j in range(32):
        bits = F.shiftrightunsigned(F.col("h"), j).bitwiseAND(lanes)
        aggregates.append(F.coalesce(F.sum(bits), F.lit(0)).alias(f"c{j}"))
    hashed = units.withColumn("h", F.when(F.col("unit").isNotNull(), F.xxhash64("unit", F.lit("unit"))))
    summed = hashed.groupBy(*keys, *carry).agg(F.count("h").alias("n"), *aggregates)
    low = [F.col(f"c{j}").bitwiseAND(F.lit(_MASK)) for j in range(32)]
    high = [F.shiftrightunsigned(F.col(f"c{j}"), 32) for j in range(32)]
    parts = [*(F.col(f"w{k}").bitwiseAND(F.lit(_MASK)) for k in range(WORDS)), F.col("n").bitwiseAND(F.lit(_MASK)), *low, *high]
    return summed.select(*keys, *carry, F.array(*parts).alias("fp"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' paragraphs together, or of `a` without those of `b` (`sign` -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def text_of(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the shared runs of words over all runs, as the signed counters estimate it."""
    def signed(fp: Column) -> Column:
        n = F.element_at(fp, WORDS + 1)
        return F.transform(F.slice(fp, WORDS + 2, COUNTERS), lambda c: (2 * c - n).cast("double"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    x, y = signed(a), signed(b)
    both = total(F.zip_with(x, y, lambda p, q: p * p + q * q))
    shared = 2 * total(F.zip_with(x, y, lambda p, q: p * q))
    return (F.when(a == b, 1.0).when(both == 0, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared / both))))


def in_blocks(docs: DataFrame) -> DataFrame:
    """`docs` with a `tie` (a hash of the text), a `zone` and a `block` in it, both in the order of ids, then ties.

    Quantiles cut the ids into zones: each quantile is one of its own, and so is what lies between two of
    them, and null ids. A zone of one id is cut by ties, which are spread evenly, the others by ids.
    So neither far ids nor an id of many documents make a large block.
    """
    shares = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10_000), F.min("doc_id"), F.max("doc_id")).first()
    cuts = sorted({*(found[0] or ()), *found[1:]} - {None})
    bounds = "cast(array({}) AS array<bigint>)".format(", ".join(f"bigint('{x}')" for x in cuts))
    less, own = f"size(filter({bounds}, b -> b < doc_id))", f"array_contains({bounds}, doc_id)"
    zone = f"CASE WHEN doc_id IS NULL THEN 0 ELSE 1 + 2 * {less} + int({own}) END"
    zoned = docs.withColumn("tie", F.xxhash64("text")).withColumn("zone", F.expr(zone))
    sizes = {r.zone: r["count"] for r in zoned.groupBy("zone").count().collect()}  # at most 2 QUANTILES + 1
    pieces = F.expr(f"map({', '.join(f'{z}, {-(-n // BLOCK)}' for z, n in sizes.items())})") if sizes else F.create_map(F.lit(0), F.lit(1))
    by_tie = F.col("tie") / F.lit(2.0 ** 64) + 0.5
    low, high = (F.expr(f"double(get({bounds}, int(zone / 2) - {k}))") for k in (1, 0))
    by_id = (F.col("doc_id").cast("double") - low) / (high - low)
    part = F.when(F.col("zone") % 2 == 0, by_tie).otherwise(by_id)
    piece = F.floor(F.least(F.greatest(part, F.lit(0.0)), F.lit(1 - 2.0 ** -40)) * F.element_at(pieces, F.col("zone")))
    return zoned.withColumn("block", F.col("zone").cast("long") * (1 << 48) + piece)


def with_next(docs: DataFrame) -> DataFrame:
    """`block`, `row` (together unique), `doc_id`, `text`, `next`: each document with the text that follows."""
    blocked = in_blocks(docs)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "tie")
    firsts = blocked.groupBy("block").agg(F.min_by("text", place).alias("text"))
    numbers = blocked.select("zone", "block").distinct()
    ends = {r.zone: r.last for r in numbers.groupBy("zone").agg(F.max("block").alias("last")).orderBy("zone").collect()}
    zones = list(ends)  # one for each quantile and gap, at most
    before = F.expr("map({})".format(", ".join(  # the last block of the zone before; of the first zone, of the last
        f"{z}, {ends[zones[i - 1]]}L" for i, z in enumerate(zones)) or "0, 0L"))
    inner = F.lag("block").over(Window.partitionBy("zone").orderBy("block"))
    links = numbers.withColumn("to", F.coalesce(inner, F.element_at(before, F.col("zone"))))
    guests = firsts.join(links, "block").select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"),
        F.col("to").alias("block"), F.lit(True).alias("guest"))
    everyone = blocked.drop("zone").withColumn("guest", F.lit(False)).unionByName(guests)
    turn = Window.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return (everyone.withColumn("next", F.lead("text").over(turn)).withColumn("row", F.row_number().over(turn))
            .where(~F.col("guest")).select("block", "row", "doc_id", "text", "next"))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness of both and of the next document.

    Edited: the last half of the characters gives way to the first as many of the next document.
    """
    pairs = with_next(documents(docs))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    wide = pairs.select("block", "row", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next")
    kinds = wide.select("block", "row", "doc_id", "n_chars", F.explode(F.array(*(
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("text", "edited", "next")))))
        .alias("x")).select("block", "row", "doc_id", "n_chars", "x.kind", "x.value")
    kinds = kinds.withColumn("sha", F.when(F.col("kind") == 1, F.sha2("value", 256)))
    found = sums(kinds, ["block", "row", "kind"], carry=("doc_id", "n_chars", "sha"))
    of = lambda k: F.first(F.when(F.col("kind") == k, F.col("fp")), ignorenulls=True)
    rows = found.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        of(0).alias("a"), of(1).alias("b"), of(2).alias("c"))
    return rows.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("a")).alias("fingerprint"),
                       text_of(F.col("b")).alias("edited_fingerprint"),
                       likeness(F.col("a"), F.col("b")).alias("near_edited"),
                       likeness(F.col("a"), F.col("c")).alias("near_next"))
