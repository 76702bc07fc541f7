"""Audit trail: structured records, appended by date."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def request_log(scanned: DataFrame, *keys: str, digits: int = 3, preview: int = 100) -> DataFrame:
    """One log row per scanned text: sizes, one line per finding, a preview."""
    number = f"%.{digits}f"
    return scanned.select(
        *keys, F.length("text").cast("long").alias("content_length"),
        F.size("findings").cast("long").alias("issue_count"),
        F.expr("transform(findings, f -> concat(f.type, ': ', f.severity, ' (confidence: ', "
               f"format_string('{number}', f.confidence), ')'))").alias("issue_lines"),
        F.substring("text", 1, preview).alias("preview"))


def audit_records(rows: DataFrame, timestamp: str, *fields: str) -> DataFrame:
    """``date`` and a JSON ``record`` with an ISO timestamp first."""
    stamp = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select(F.to_date(timestamp).alias("date"),
                       F.to_json(F.struct(stamp.alias("timestamp"), *fields)).alias("record"))


def append_audit(records: DataFrame, path: str, batch: str, enabled: bool = True) -> bool:
    """Add one batch of records to the trail at ``path``, wholly or not at all; whether it was added.

    The records are written to a folder of their own first. A small commit file that names it makes
    them visible, and it is put in place by a rename, last: a write that dies before that leaves
    nothing to see, and a batch that has a commit is not added again.
    """
    if not enabled:
        return False
    spark = records.sparkSession
    fs, commit = _place(spark, f"{path}/commits/{batch}.json")
    if fs.exists(commit):
        return False
    attempt = uuid.uuid4().hex
    records.write.partitionBy("date").parquet(f"{path}/records/batch={batch}/attempt={attempt}")
    _, draft = _place(spark, f"{path}/drafts/{attempt}.json")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt}).encode()))
    finally:
        out.close()
    fs.mkdirs(commit.getParent())
    return fs.rename(draft, commit)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The records of all batches that were committed: ``batch, date, record``. Other files are not read:
    the commits prune the folders."""
    commits = spark.read.schema("batch string, attempt string").json(f"{path}/commits")
    records = spark.read.schema("record string, batch string, attempt string, date date").parquet(f"{path}/records")
    return records.join(commits, ["batch", "attempt"]).select("batch", "date", "record")


def audit_batch(path: str):
    """A ``foreachBatch`` writer that may be repeated: a batch is added once."""
    def write(records: DataFrame, batch_id: int) -> None:
        append_audit(records, path, str(batch_id))
    return write


def _place(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
