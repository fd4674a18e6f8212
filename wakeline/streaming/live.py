"""Live messages: parsing, demultiplexing, enrichment by keyed state, and the rotated file sink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.sources.files import scratch

MESSAGE = "MessageType string, MetaData struct<mmsi:long,latitude:double,time_utc:string>, Message struct<Latitude:double,ImoNumber:long,Static:long,Seq:long,Sec:long>"
ENRICHED = "seq long, mmsi long, latest long"


def live_time(text: Column) -> Column:
    """Seconds since 1970 of '2024-01-15 10:00:00.000000000 +0000 UTC'; null if it can't be read."""
    plain = F.split_part(text, F.lit(" +"), F.lit(1)).try_cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), plain)


def fields(value: Column) -> Column:
    """A message's fields: the body's latitude or else the header's; an IMO number of 0 is unknown."""
    m = F.from_json(value, MESSAGE)
    return F.element_at(
        F.transform(
            F.array(m),
            lambda x: F.struct(
                x["MessageType"].alias("kind"),
                x["MetaData"]["mmsi"].alias("mmsi"),
                F.coalesce(x["Message"]["Latitude"], x["MetaData"]["latitude"]).alias("lat"),
                F.nullif(x["Message"]["ImoNumber"], F.lit(0)).alias("imo"),
                x["Message"]["Static"].alias("static"),
                x["Message"]["Seq"].alias("seq"),
                x["Message"]["Sec"].alias("sec"),
            ),
        ),
        1,
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Positions and static reports of a stream (or table) of JSON lines; other messages are ignored."""
    return lines.select(fields(F.col("value")).alias("m")).select("m.*").where(F.col("kind").isin("PositionReport", "ShipStaticData"))


def _enrich(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Positions of one vessel with the static data last seen before them; arrival order is (sec, seq)."""
    rows = pd.concat(list(batches)).sort_values(["sec", "seq"])
    static = rows["static"].where(rows["kind"] == "ShipStaticData").ffill()
    if state.exists:
        static = static.fillna(state.get[0])
    if len(static) and pd.notna(static.iloc[-1]):
        state.update((int(static.iloc[-1]),))
    at = rows["kind"] == "PositionReport"
    yield pd.DataFrame({"seq": rows["seq"][at].astype("Int64"), "mmsi": key[0], "latest": static[at].astype("Int64")})


def enriched(messages: DataFrame) -> DataFrame:
    """Keyed state: each position gets its vessel's latest static report, never a later one."""
    return messages.groupBy("mmsi").applyInPandasWithState(_enrich, ENRICHED, "static long", "append", GroupStateTimeout.NoTimeout)


def static_fields(value: Column) -> Column:
    """A static report's length and width (both parts added, 0 is unknown) and IMO number (0 and empty are unknown)."""
    m = F.from_json(value, "Seq long, Dimension struct<A:int,B:int,C:int,D:int>, ImoNumber string")
    size = lambda x, a, b: F.nullif(F.coalesce(x["Dimension"][a], F.lit(0)) + F.coalesce(x["Dimension"][b], F.lit(0)), F.lit(0)).cast("long")
    known = lambda x: F.when(~F.trim(x).isin("", "0"), x)
    return F.element_at(F.transform(F.array(m), lambda x: F.struct(x["Seq"].alias("seq"), size(x, "A", "B").alias("length"), size(x, "C", "D").alias("width"), known(x["ImoNumber"]).alias("imo"))), 1)


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """One row for each key while the watermark keeps it in mind."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """(mmsi, begin, n): runs of pings with less than gap between them."""
    # a session window also takes the ping that comes just when the gap is over
    less = f"{pd.Timedelta(gap) // pd.Timedelta(microseconds=1) - 1} microseconds"
    return stream.groupBy("mmsi", F.session_window("at", less).alias("w")).agg(F.count("*").alias("n")).select("mmsi", F.col("w.start").alias("begin"), "n")


def gaps(stream: DataFrame, longer_s: int, forget: str | None = None) -> DataFrame:
    """(mmsi, t_start, t_end): silences of more than longer_s seconds, with the last ping's time as keyed state.

    Pings are taken in time's order within a batch; one older than the state (late) opens no silence. With
    forget (say "7 days") a vessel's state goes when it has not been heard for that long by the wall clock.
    """
    limit = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    span = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else 0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        every = np.sort(np.concatenate([b["sec"].to_numpy() for b in batches]))
        new = every if last is None else np.concatenate([[last], every[every > last]])
        at = np.flatnonzero(np.diff(new) > longer_s)
        if len(new):
            state.update((int(new[-1]),))
            if span:
                state.setTimeoutDuration(span)
        yield pd.DataFrame({"mmsi": key[0], "t_start": new[at], "t_end": new[at + 1]})

    return stream.groupBy("mmsi").applyInPandasWithState(run, "mmsi long, t_start long, t_end long", "last long", "append", limit)


def completed(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all there is; its last whole result."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{k}")
        batch.sparkSession.createDataFrame([(k,)], "k long").write.mode("append").parquet(f"{out}-done")

    query = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", scratch(spark, f"{name}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.schema("k long").parquet(f"{out}-done").agg(F.max("k")).first()[0]
    return spark.read.schema(stream.schema).parquet(f"{out}/{last}")


def recorded(stream: DataFrame, out: str, log: str, seconds: int, minutes: float | None = None) -> DataFrame:
    """Records a stream into files by spans of seconds until the deadline, or until all there is has been read.

    What came before the end is flushed; a later call with the same log goes on where this one stopped, so no
    row is lost or written twice.
    """
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append")
    if minutes is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime=f"{seconds} seconds").start()
        if not query.awaitTermination(round(minutes * 60)):
            query.processAllAvailable()
            query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def landed(stream: DataFrame, name: str, seconds: int | None = None) -> DataFrame:
    """Runs a stream into Parquet files and reads them; with seconds, one micro-batch for each such span."""
    spark: SparkSession = stream.sparkSession
    out, log = scratch(spark, name), scratch(spark, f"{name}-log")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append")
    query = (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
    query.processAllAvailable() if seconds else query.awaitTermination()
    query.stop()
    return spark.read.schema(stream.schema).parquet(out)
