"""Shared storage and Arrow helpers for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch handed to Python. Texts can be long, so batches stay small.
ARROW_ROWS = 1000
#: Where the tables that cut wrote are.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local session may go without the setting; it then gets a temporary folder of its own.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None) or _set_before(spark):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="wakeline-")
    spark.sparkContext.setCheckpointDir(folder)
    return "file://" + folder


def _set_before(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again, in buckets of a column if one is named.

    Later steps neither recompute it nor depend on the executors that made it; what groups by the bucket's column needn't move it.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    if bucket is None:
        df.write.parquet(path)
        table = spark.read.schema(df.schema).parquet(path)
    else:
        known = f"wakeline_{uuid.uuid4().hex}"
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket).option("path", path).saveAsTable(known)
        table = spark.table(known)
        # the files stay, and the table is read by its path
        spark.sql(f"DROP TABLE {known}")
    _PATHS[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut wrote. All that is made of them must have been written by then."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within deletes its shuffle files as soon as it is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of at most ARROW_ROWS rows."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
