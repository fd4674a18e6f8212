"""Radar detections against reported positions, by cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import HexGrid


def corroborated(radar: DataFrame, reports: DataFrame, grid: HexGrid) -> DataFrame:
    """radar with dark: no report in the detection's cell or around it. Without any report, none is dark.

    Rows without a position are dropped on both sides.
    """
    cells = reports.na.drop(subset=["lat", "lon"]).select(F.explode(grid.disk(grid.cell(F.col("lat"), F.col("lon")))).alias("near")).distinct()
    some = cells.limit(1).agg((F.count("*") > 0).alias("some"))
    at = radar.na.drop(subset=["lat", "lon"]).withColumn("cell", grid.cell(F.col("lat"), F.col("lon")))
    marked = at.join(cells.withColumn("seen", F.lit(True)), F.col("cell") == F.col("near"), "left").crossJoin(F.broadcast(some))
    return marked.withColumn("dark", F.col("some") & F.col("seen").isNull()).drop("near", "seen", "some")
