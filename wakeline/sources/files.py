"""Landing files: typed CSV and JSON scans, Parquet sinks by partition, and guards around them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); in local mode a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wakeline-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; empty is null, a row that doesn't fit fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path, header=True)


def ingest(df: DataFrame, path: str) -> int:
    """Parquet with zstd; the number of rows, observed while they are written."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.option("compression", "zstd").mode("overwrite").parquet(path)
    return seen.get["n"]


def write_single(df: DataFrame, path: str) -> None:
    """One Parquet file, for results of few rows."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_by(df: DataFrame, path: str, *by: str) -> None:
    """Parquet under Hive folders, dealt by them so that each gets few files."""
    df.repartition(*by).write.partitionBy(*by).option("compression", "zstd").mode("overwrite").parquet(path)


def write_unless_empty(df: DataFrame, path: str) -> bool:
    """Overwrites path; an empty result leaves what is there, and False."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True
