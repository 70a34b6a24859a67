"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_FOLDER = "file:///tmp/checkpoints/recordcheck"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a default of its own on a local master, where every task runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return DEFAULT_FOLDER


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over tasks by keys. The number is given, as Spark would merge parts of less than 1 MB, however much work their rows are."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def stored(df: DataFrame, label: str, sorts: bool = True) -> DataFrame:
    """A table written once and read back: its plan is a scan from then on, and lost executors cost no earlier work.

    It compresses to a small part of its rows, so its bytes would have Spark send it whole through the driver: it joins by sorting,
    unless `sorts` is False, for what stays small however large the input is.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.hint("merge") if sorts else back
