"""Moving windows over days from mergeable day summaries: only days that are new are read.

A day's row holds exact sums and two sketches, of which many merge into one: HyperLogLog for distinct vessels, KLL for quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Logarithm of the distinct counter's registers (relative standard error 1.04 / 2^(12/2), 1.6 %), and KLL's k
#: (rank error below 0.7 % with 99 % confidence).
LOG_REGISTERS, KLL_K = 12, 400


def summaries(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(n, total, keys, quantiles, day) of each day; null keys aren't counted, null values are in n alone."""
    return rows.groupBy("day").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.hll_sketch_agg(key, F.lit(LOG_REGISTERS)).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantiles"),
    )


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def refresh(spark: SparkSession, source: str, path: str, key: str = "mmsi", value: str = "sog", redo: tuple[int, ...] = ()) -> list[int]:
    """Brings the summaries under path up to date with a table partitioned by day (int); the days that were read.

    Those are the days that have no summary, and those in redo, which late rows have changed. Their folders alone are
    scanned, and overwritten; other days stay as they are, also where their rows are gone from the source by now.
    """
    rows, known = spark.read.parquet(source), _read(spark, path)
    of = lambda df: {r["day"] for r in df.select("day").distinct().collect()} - {None}
    days = of(rows)
    new = sorted(days if known is None else days - of(known) | days & {*redo})
    if new:
        fresh = summaries(rows.where(F.col("day").isin(new)), key, value)
        fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return new


def windows(days: DataFrame, size: int = 30) -> DataFrame:
    """(day, n, total, keys, quantiles): for each day with a summary, those of the size days that end with it merged."""
    ends = days.select(F.col("day").alias("end"))
    spread = days.withColumn("end", F.explode(F.sequence("day", F.col("day") + (size - 1)))).join(ends, "end", "left_semi")
    out = spread.groupBy("end").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    return out.withColumnRenamed("end", "day")


def distinct(sketch: str = "keys") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "quantiles") -> Column:
    """The value at that share, null without values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))
