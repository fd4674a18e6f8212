"""Vessel pings as a view over the events table, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = (-118.5, 33.45, -117.9, 33.95)
PORT = (-118.30, 33.70, -118.10, 33.80)
POINT = (33.7474, -118.2191)

SQL = """
lens AS (SELECT event_id, user_id + 200000000 AS mmsi, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS sec,
  33.4::DOUBLE + 0.6::DOUBLE * ((event_id * 37) % 1009)::DOUBLE / 1009::DOUBLE AS lat, -118.6::DOUBLE + 0.8::DOUBLE * ((event_id * 91) % 997)::DOUBLE / 997::DOUBLE AS lon,
  CASE WHEN event_type = 'error' THEN 102.3::DOUBLE ELSE value / 10 END AS sog, CASE WHEN event_type = 'click' THEN 360::DOUBLE ELSE ((event_id * 53) % 360)::DOUBLE END AS cog,
  CASE WHEN event_type = 'view' THEN 511::DOUBLE ELSE ((event_id * 17) % 360)::DOUBLE END AS heading, event_type, value, props FROM events)"""


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    kind = lambda name, special, other: F.when(F.col("event_type") == name, F.lit(special)).otherwise(other)
    return e.select(
        "event_id",
        (F.col("user_id") + 200000000).alias("mmsi"),
        sec.alias("sec"),
        (F.lit(33.4) + F.lit(0.6) * (i * 37 % 1009) / 1009.0).alias("lat"),
        (F.lit(-118.6) + F.lit(0.8) * (i * 91 % 997) / 997.0).alias("lon"),
        kind("error", 102.3, F.col("value") / 10).alias("sog"),
        kind("click", 360.0, (i * 53 % 360).cast("double")).alias("cog"),
        kind("view", 511.0, (i * 17 % 360).cast("double")).alias("heading"),
        "event_type", "value", "props",
    )
