"""Trajectories: de-duplication, segments between consecutive pings, jumps, gaps, arrivals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import EARTH_KM, haversine_km, speed_kn

# fixed values: sentinels, gap and jump limits
NO_SOG, NO_COG, NO_HEADING = 102.3, 360.0, 511.0
GAP_S, JUMP_KN = 1800, 60.0


def by_vessel():
    return Window.partitionBy("mmsi").orderBy("sec", "event_id")


def clip(df: DataFrame, lon1: float, lat1: float, lon2: float, lat2: float) -> DataFrame:
    """Pings with a key inside the box, its edge included."""
    return df.where(F.col("lon").between(lon1, lon2) & F.col("lat").between(lat1, lat2) & F.col("mmsi").isNotNull() & F.col("sec").isNotNull())


def without_sentinels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in (("sog", NO_SOG), ("cog", NO_COG), ("heading", NO_HEADING))})


def deduplicated(df: DataFrame) -> DataFrame:
    """One ping of each vessel and time: the one with the least position, then event_id.

    Dealt by vessel up front, so that the trajectory windows need no second shuffle.
    """
    first = Window.partitionBy("mmsi", "sec").orderBy("lat", "lon", "event_id")
    return df.repartition("mmsi").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def segments(df: DataFrame) -> DataFrame:
    """Adds dt_s, dist_km, implied_kn and gap_flag against the vessel's previous ping."""
    w = by_vessel()
    before = df.withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w), "sec0": F.lag("sec").over(w)})
    return measured(before)


def measured(before: DataFrame) -> DataFrame:
    """Figures against the previous ping, which stands beside as lat0, lon0 and sec0; these go."""
    dt = F.col("sec") - F.col("sec0")
    dist = F.coalesce(haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), F.lit(0.0))
    out = before.withColumn("dt_s", dt).withColumn("dist_km", dist)
    return out.withColumn("implied_kn", speed_kn(F.col("dist_km"), F.col("dt_s"))).withColumn("gap_flag", F.col("dt_s") > GAP_S).drop("lat0", "lon0", "sec0")


def without_jumps(df: DataFrame) -> DataFrame:
    """One pass: what stays keeps its figures against dropped neighbours."""
    return df.where(F.col("implied_kn").isNull() | (F.col("implied_kn") <= JUMP_KN))


def silver(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return without_jumps(segments(deduplicated(without_sentinels(clip(df, *box)))))


def gaps(df: DataFrame, longer_s: int = GAP_S) -> DataFrame:
    """Intervals between consecutive pings longer than the limit, with what was known before."""
    w = by_vessel()
    ok = df.where((F.col("mmsi") > 99999999) & F.col("sec").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    pre = ok.withColumns({n: F.lag(c).over(w) for n, c in (("t_start", "sec"), ("lat0", "lat"), ("lon0", "lon"), ("sog_before", "sog"))})
    found = pre.where((F.col("sec") - F.col("t_start")) > longer_s)
    dist = haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    out = found.select("event_id", "mmsi", "t_start", F.col("sec").alias("t_end"), ((F.col("sec") - F.col("t_start")) / F.lit(3600.0)).alias("gap_h"), dist.alias("dist_km"), "sog_before", "lat0", "lon0", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.floor(F.col("t_start") % 86400 / 3600).cast("int").alias("hour0"))
    return out.withColumn("implied_kn", speed_kn(F.col("dist_km"), F.col("gap_h") * 3600.0))


def dark_rule() -> Column:
    """Long, moving before, far, and at a plausible speed; unknown counts as no."""
    rule = (F.col("gap_h") >= 2) & (F.col("sog_before") >= 3) & (F.col("dist_km") >= 5) & F.col("implied_kn").between(1, 40)
    return F.coalesce(rule, F.lit(False))


def dark_candidates(found: DataFrame) -> DataFrame:
    return found.where((F.col("implied_kn") <= JUMP_KN) & (F.col("dist_km") >= 0)).withColumn("rule_flag", dark_rule())


def entries(df: DataFrame) -> DataFrame:
    """Adds entry: inside now and not at the ping before; a track that begins inside enters there."""
    return df.withColumn("entry", F.col("inside") & ~F.lag("inside", 1, False).over(by_vessel()))


def next_arrival(df: DataFrame) -> DataFrame:
    """Forward as-of join by a window: the earliest entry at or after each ping.

    From the last ping to the first, so that the frame grows by a row at a time; pings of one time are peers.
    """
    ahead = Window.partitionBy("mmsi").orderBy(F.desc("sec")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("arrival", F.min(F.when(F.col("entry"), F.col("sec"))).over(ahead))


def eta_label(df: DataFrame, horizon_min: float = 720.0) -> DataFrame:
    eta = (F.col("arrival") - F.col("sec")) / F.lit(60.0)
    return df.withColumn("eta_min", eta).withColumn("has_eta", F.coalesce(F.col("eta_min").between(0, horizon_min) & ~F.col("inside"), F.lit(False)))


def last_known(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Backward as-of join by a window: the latest value so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(by_vessel().rowsBetween(Window.unboundedPreceding, 0)))


def sequences(df: DataFrame, features: list[str], k: int = 16) -> DataFrame:
    """The last k pings as an array, for pings that have k and a label."""
    w = by_vessel().rowsBetween(-(k - 1), 0)
    return df.withColumn("steps", F.collect_list(F.struct(*features)).over(w)).where((F.size("steps") == k) & F.col("has_eta"))


def longest_leg(rows: pd.DataFrame) -> pd.DataFrame:
    """(mmsi, longest_km, n) of one vessel's pings."""
    t = rows.sort_values(["sec", "event_id"])
    lat, lon = np.radians(t["lat"].to_numpy()), np.radians(t["lon"].to_numpy())
    h = np.sin(np.diff(lat) / 2) ** 2 + np.cos(lat[:-1]) * np.cos(lat[1:]) * np.sin(np.diff(lon) / 2) ** 2
    legs = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
    return pd.DataFrame({"mmsi": [t["mmsi"].iloc[0]], "longest_km": [float(legs.max()) if len(legs) else 0.0], "n": [len(t)]})
