"""Global ranks, running totals and exact quantiles without one task that sees all rows.

Rows are dealt into ranges of the order and written; counts (or sums) by range are few rows, and what lies
before a range is added to what a window inside it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.sources.files import scratch


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """df as a table with _part, the number of its range."""
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all rows up to this one in a total order; null values count as 0."""
    dealt = _dealt(df.withColumn("_v", F.coalesce(value, F.lit(0))), order)
    sums = dealt.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    # one row for each range, so one task of a few thousand rows at most
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.sum("_v").over(here) + F.col("_before")).drop("_part", "_v", "_before")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): exact quantiles with linear interpolation; nulls don't count, NaN is the largest number.

    No row gives null values. Values are counted first, and those counts written, so that a frequent value is one row and what
    df is made from runs once.
    """
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    path = scratch(spark, "values")
    counts.write.parquet(path)
    ranked = running(spark.read.schema(counts.schema).parquet(path), [F.col("x")], F.col("n"), "last").withColumn("first", F.col("last") - F.col("n") + 1)
    wanted = spark.createDataFrame([(s,) for s in shares], "share double")
    n = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    at = wanted.crossJoin(F.broadcast(n)).withColumn("at", F.col("share") * (F.col("n") - 1) + 1)
    near = at.select("share", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    met = ranked.drop("n").join(F.broadcast(near), F.col("rank").between(F.col("first"), F.col("last")), "right").groupBy("share", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return met.select("share", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))


def busiest(cells: DataFrame, share: float) -> DataFrame:
    """(cell, n): cells by falling n (ties by cell) until they hold that share of all n."""
    run = running(cells, [F.desc("n"), F.col("cell")], F.col("n"), "run")
    total = cells.agg(F.sum("n").alias("total"))
    return run.crossJoin(F.broadcast(total)).where(F.col("run") - F.col("n") < F.lit(share) * F.col("total")).select("cell", "n")
