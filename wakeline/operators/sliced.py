"""Trajectory windows for vessels whose track doesn't fit one task: slices of time, with boundary rows carried between them.

A vessel with many pings is cut into slices of about equal numbers, by counts of its hours. Windows run within (vessel, slice);
what they need from before or after a slice is carried over from the other slices, of which there are few: the
last rows of earlier ones as rows of their own, and running minima or last values as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators import track

#: Pings that one task may hold of one vessel, and the seconds by which its pings are counted.
SLICE_ROWS, BUCKET_S = 1_000_000, 3600
_SLICE = ("mmsi", "slice")


def sliced(df: DataFrame, rows: int = SLICE_ROWS, bucket_s: int = BUCKET_S) -> DataFrame:
    """df with slice, a number that grows with time within a vessel; 0 for vessels of at most `rows` pings.

    A slice ends with the bucket of time that brings it to `rows` pings, so pings of one time stay together. The vessels that
    are cut, at most one for each `rows` pings, and their buckets are a small table; Spark broadcasts it if it is small enough.
    """
    bucket = F.floor(F.col("sec") / bucket_s)
    counts = df.where("mmsi IS NOT NULL").groupBy("mmsi", bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    large = counts.groupBy("mmsi").agg(F.sum("_n").alias("_all")).where(F.col("_all") > rows).select("mmsi")
    before = Window.partitionBy("mmsi").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.join(large, "mmsi", "left_semi").select("mmsi", "_bucket", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows).cast("int").alias("_slice"))
    # the cut vessels' pings meet the buckets by bucket, so that no task gets all of one
    out = df.withColumn("_bucket", bucket).join(cut, ["mmsi", "_bucket"], "left")
    return out.withColumn("slice", F.coalesce("_slice", F.lit(0))).drop("_bucket", "_slice")


def _order(descending: bool = False) -> list[Column]:
    return [F.desc("sec"), F.desc("event_id")] if descending else [F.col("sec"), F.col("event_id")]


def with_carried(df: DataFrame, k: int) -> DataFrame:
    """df and, marked carried, the last k pings before each slice as rows of that slice.

    After it, a window over (mmsi, slice) that looks back at most k rows sees what it would see in the whole track; rows marked
    carried are then dropped.
    """
    dealt = df.repartition(*_SLICE)
    last = Window.partitionBy(*_SLICE).orderBy(*_order(True))
    row = F.struct("sec", "event_id", F.struct(*df.columns).alias("row"))
    tails = dealt.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= k).groupBy(*_SLICE).agg(F.array_sort(F.collect_list(row)).alias("tail"))
    # each slice has a row at least, so the k slices before hold what is needed
    back = Window.partitionBy("mmsi").orderBy("slice").rowsBetween(-k, -1)
    before = F.flatten(F.collect_list("tail").over(back))
    carried = tails.withColumn("before", before).select("mmsi", "slice", F.explode(F.slice("before", F.greatest(F.size("before") - k + 1, F.lit(1)), k)).alias("b"))
    moved = carried.select("b.row.*", F.col("slice").alias("_to")).withColumn("slice", F.col("_to")).drop("_to").withColumn("carried", F.lit(True))
    return dealt.withColumn("carried", F.lit(False)).unionByName(moved).repartition(*_SLICE)


def by_slice() -> Window:
    return Window.partitionBy(*_SLICE).orderBy("sec", "event_id")


def segments(df: DataFrame) -> DataFrame:
    """track.segments of a track in slices; df has the column slice."""
    w = by_slice()
    both = with_carried(df, 1)
    before = both.withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w), "sec0": F.lag("sec").over(w)}).where("NOT carried").drop("carried")
    return track.measured(before)


def deduplicated(df: DataFrame) -> DataFrame:
    """track.deduplicated; pings of one time are in one slice."""
    first = Window.partitionBy(*_SLICE, "sec").orderBy("lat", "lon", "event_id")
    return df.repartition(*_SLICE).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def entries(df: DataFrame) -> DataFrame:
    """track.entries of a track in slices."""
    found = with_carried(df, 1).withColumn("entry", F.col("inside") & ~F.lag("inside", 1, False).over(by_slice()))
    return found.where("NOT carried").drop("carried")


def next_arrival(df: DataFrame) -> DataFrame:
    """track.next_arrival of a track in slices: within the slice, or else the first entry of a later one."""
    entry = F.min(F.when(F.col("entry"), F.col("sec")))
    later = Window.partitionBy("mmsi").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    firsts = df.groupBy(*_SLICE).agg(entry.alias("_first")).withColumn("_later", F.min("_first").over(later)).select(*_SLICE, "_later")
    ahead = Window.partitionBy(*_SLICE).orderBy(F.desc("sec")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = df.repartition(*_SLICE).withColumn("_own", entry.over(ahead)).join(firsts, list(_SLICE))
    return own.withColumn("arrival", F.coalesce("_own", "_later")).drop("_own", "_later")


def last_known(df: DataFrame, value: Column, name: str) -> DataFrame:
    """track.last_known of a track in slices: within the slice, or else the last value of an earlier one."""
    back = Window.partitionBy("mmsi").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    lasts = df.groupBy(*_SLICE).agg(F.max_by(value, F.when(value.isNotNull(), F.struct("sec", "event_id"))).alias("_last"))
    lasts = lasts.withColumn("_before", F.last("_last", ignorenulls=True).over(back)).select(*_SLICE, "_before")
    own = df.repartition(*_SLICE).withColumn("_own", F.last(value, ignorenulls=True).over(by_slice().rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(lasts, list(_SLICE), "left").withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before")


def sequences(df: DataFrame, features: list[str], k: int = 16) -> DataFrame:
    """track.sequences of a track in slices."""
    w = by_slice().rowsBetween(-(k - 1), 0)
    steps = with_carried(df, k - 1).withColumn("steps", F.collect_list(F.struct(*features)).over(w))
    return steps.where((F.size("steps") == k) & F.col("has_eta") & ~F.col("carried")).drop("carried")
