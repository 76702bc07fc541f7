"""Files of JSON lines: typed rows, and a quarantine that says where each bad line is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.sources.tables import stored

#: The columns of a request log line.
REQUEST_LINE = ("request_id string, model string, messages array<struct<role:string,content:string>>, "
                "temperature double, max_tokens bigint, top_p double, stream boolean")
CORRUPT = "_corrupt"


def line_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The lines of a folder's files as a stream; a file is read whole in one batch. Let each batch go
    through ``numbered`` first."""
    source = spark.readStream
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return _located(source.text(folder))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a folder's files: ``line``, the file and block that each is from, and its ``id`` there."""
    return numbered(_located(spark.read.text(folder)))


def numbered(located: DataFrame) -> DataFrame:
    """Add an ``id`` that grows along each block; to be called before lines are moved about."""
    return located.withColumn("id", F.monotonically_increasing_id())


def _located(text: DataFrame) -> DataFrame:
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"))


def parse_lines(located: DataFrame, schema: str = REQUEST_LINE) -> DataFrame:
    """The declared columns of each line beside those of ``lines``. A line that is no JSON
    object, or holds a value of another type, has it in ``_corrupt``; an empty line has an empty text there."""
    parsed = F.from_json("line", f"{schema}, {CORRUPT} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = located.select("*", parsed.alias("r"))
    names = [f for f in rows.select("r.*").columns if f != CORRUPT]
    whole = F.expr("trim(line)").startswith("{")
    return rows.select("line", "file", "block", "id", *[F.col(f"r.{c}") for c in names],
                       F.when(F.col("r").isNull() | ~whole, F.col("line")).otherwise(F.col(f"r.{CORRUPT}")).alias(CORRUPT))


def good_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNull()).drop("line", "file", "block", "id", CORRUPT)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Bad lines with their file and line number (from 1): ``file, line_number, line``.

    A file may be read in blocks by many tasks. Lines have ids within a block; the counts of the blocks
    before it, one small row for each block, give the rest. The ids are stored once, so both uses of them
    see the same.
    """
    kept = stored(parsed.select(
        "file", "block", "id", F.when(F.col(CORRUPT).isNotNull(), F.col("line")).alias("bad")), "lines")
    blocks = kept.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = blocks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "first", "n"))).alias("all")).select(
        "file", F.explode(F.expr("transform(all, (x, i) -> struct(x.block AS block, x.first AS first, "
                                 "aggregate(slice(all, 1, i), 0L, (a, y) -> a + y.n) AS earlier))")).alias("b")).select("file", "b.*")
    return (kept.where("bad IS NOT NULL").join(before, ["file", "block"])
            .select("file", F.expr("earlier + id - first + 1").alias("line_number"), F.col("bad").alias("line")))
