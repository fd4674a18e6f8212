"""Synthetic blackouts and the share of them that detection finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.scalar import sample_key
from wakeline.operators import track


def dense_movers(df: DataFrame, more_than: int, limit: int, seed: int = 42) -> DataFrame:
    """Vessels with many pings under way, picked in a fixed pseudo-random order."""
    moving = df.where(F.col("sog").between(3, 30)).groupBy("mmsi").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return moving.orderBy(sample_key(seed, F.col("mmsi")), "mmsi").limit(limit)


def anchors(df: DataFrame, hours: float, seed: int = 42) -> DataFrame:
    """One ping of each vessel at which a blackout may begin."""
    last = F.max("sec").over(Window.partitionBy("mmsi"))
    pick = Window.partitionBy("mmsi").orderBy(sample_key(seed, F.col("event_id")), "event_id")
    able = df.withColumn("last", last).where((F.col("sog") >= 3) & (F.col("sec") <= F.col("last") - int(hours * 3600)))
    return able.withColumn("rn", F.row_number().over(pick)).where("rn = 1").select("mmsi", F.col("sec").alias("anchor"), (F.col("sec") + int(hours * 3600)).alias("until"))


def blacked_out(df: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pings that stay, blackouts that delete at least one): interval anti and semi joins by vessel."""
    c = cuts.withColumnRenamed("mmsi", "vessel")
    inside = (F.col("mmsi") == F.col("vessel")) & (F.col("sec") > F.col("anchor")) & (F.col("sec") <= F.col("until"))
    return df.join(c, inside, "left_anti"), c.join(df, inside, "left_semi").withColumnRenamed("vessel", "mmsi")


def recall(kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_truth, n_hit): blackouts covered by a flagged gap of the same vessel."""
    flagged = track.dark_candidates(track.gaps(kept)).where("rule_flag").select(F.col("mmsi").alias("vessel"), "t_start", "t_end")
    cover = (F.col("mmsi") == F.col("vessel")) & (F.col("t_start") <= F.col("anchor")) & (F.col("t_end") >= F.col("until"))
    hit = truth.join(flagged, cover, "left").groupBy("mmsi").agg(F.max(F.col("vessel").isNotNull()).alias("hit"))
    return hit.agg(F.count("*").alias("n_truth"), F.count_if("hit").alias("n_hit"))


def ratio() -> Column:
    """hits of truth; NaN where there is no truth."""
    return F.when(F.col("n_truth") == 0, F.lit(float("nan"))).otherwise(F.col("n_hit") / F.col("n_truth"))
