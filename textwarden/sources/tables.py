"""Reading input tables and keeping intermediate ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One parquet table, only the named columns."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table


def spread(texts: DataFrame) -> DataFrame:
    """Give every core some rows when the input is smaller than the cluster
    (for example one small file); larger inputs keep their splits."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it. Only a local
    session that names none gets a folder of its own, once."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not folder:
        if context.master.partition("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textwarden-")
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once,
    survives the loss of executors, and has a short lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write a table once, dealt by ``key`` into sorted buckets (as many as the session's shuffle
    partitions), and read it back. Tables with the same key and buckets are joined and grouped by it
    without a shuffle."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return spark.table(name)
