"""Named queries of the models: sequences, scaler, boosted trees, isolation forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.ml import eta, forest
from wakeline.operators import injection, track
from wakeline.plans import lens, sql
from wakeline.plans.queries import HEXDIGIT, INJECT, R4, _dark, _eta, _port_km, _source, query, saved
from wakeline.sources import files

SPLIT = f"CASE WHEN {HEXDIGIT} < 70 THEN 'train' WHEN {HEXDIGIT} < 85 THEN 'val' ELSE 'test' END"
ANGLES = ", ".join(f"{f}(radians(coalesce({a}, 0))) AS {f}_{a}" for a in eta.ANGLES for f in ("cos", "sin"))
FEATURED = f"""{sql.ETA}, base AS (SELECT *, {sql.DIST} AS port_km, {sql.BEAR} AS port_deg FROM eta),
feat AS (SELECT event_id, mmsi, sec, inside, eta_min, has_eta, coalesce(sog, 0) AS sog, port_km, coalesce(dt_s, 0)::DOUBLE AS dt_s, dist_km, {ANGLES} FROM base)"""
LISTS = ", ".join(f"list({c}) OVER w AS l_{c}" for c in eta.FEATURES)
SEQ = f"""{FEATURED}, win AS (SELECT *, count(*) OVER w AS k, {LISTS} FROM feat WINDOW w AS (PARTITION BY mmsi ORDER BY sec, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
seq AS (SELECT *, ln(1 + eta_min) AS y, {SPLIT} AS split FROM (SELECT *, md5(mmsi::VARCHAR) AS h FROM win WHERE k = 16 AND has_eta)),
steps AS (SELECT {", ".join(f"unnest(l_{c}) AS {c}" for c in eta.CONTINUOUS)} FROM seq WHERE split = 'train')"""


def _gold(s, d) -> DataFrame:
    deg = geo.bearing_deg(F.col("lat"), F.col("lon"), F.lit(lens.POINT[0]), F.lit(lens.POINT[1]))
    return _eta(s, d).withColumns({"port_km": _port_km(), "port_deg": deg})


def _sequences(s, d) -> DataFrame:
    return eta.sequences(_gold(s, d))


@query(f"SELECT event_id, {', '.join(f'round({c}, 4) + 0::DOUBLE AS {c}' for c in eta.FEATURES)} FROM feat", FEATURED)
def eta_features(s, d):
    return eta.featured(_gold(s, d)).select("event_id", *(R4(c).alias(c) for c in eta.FEATURES))


@query(f"SELECT event_id, split, round(y, 4) AS y, {', '.join(f'round(list_sum(l_{c}), 3) AS {c}' for c in eta.FEATURES)} FROM seq", SEQ)
def eta_sequences(s, d):
    total = lambda c: F.round(F.aggregate("steps", F.lit(0.0), lambda a, v: a + v[c]), 3).alias(c)
    return _sequences(s, d).select("event_id", "split", R4("y").alias("y"), *map(total, eta.FEATURES))


@query("SELECT coalesce(sum(labels) FILTER (WHERE pings < 16), 0)::BIGINT AS n FROM (SELECT mmsi, count(*) AS pings, count(*) FILTER (WHERE has_eta) AS labels FROM eta GROUP BY 1)", sql.ETA)
def eta_skipped(s, d):
    return eta.skipped(_eta(s, d))


SCALER = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) + 1e-6 AS std FROM steps" for c in eta.CONTINUOUS)


@query(f"SELECT feature, round(mean, 4) AS mean, round(std, 4) AS std FROM ({SCALER})", SEQ)
def eta_scaler(s, d):
    return eta.scaler(_sequences(s, d)).select("feature", R4("mean").alias("mean"), R4("std").alias("std"))


@query(f"SELECT event_id, {', '.join(f'round(({c} - (SELECT mean FROM ({SCALER}) WHERE feature = {chr(39)}{c}{chr(39)})) / (SELECT std FROM ({SCALER}) WHERE feature = {chr(39)}{c}{chr(39)}), 4) AS {c}' for c in eta.CONTINUOUS)} FROM seq", SEQ)
def eta_standardized(s, d):
    """The last step of each scaled sequence."""
    rows = saved(_sequences(s, d), "sequences")
    scaled = eta.standardized(rows, eta.scaler(rows)).withColumn("z", F.element_at("steps", -1))
    return scaled.select("event_id", *(R4(f"z.{c}").alias(c) for c in eta.CONTINUOUS))


@query("SELECT split, count(*) AS n, round(avg(abs((exp(ln(1 + port_km / (greatest(sog, 0.5) * 1.852) * 60)) - 1) - (exp(y) - 1))), 3) AS mae FROM seq GROUP BY 1", SEQ)
def eta_naive_by_split(s, d):
    error = eta.mae(F.log1p(eta.naive_minutes()), F.col("y"))
    return _sequences(s, d).groupBy("split").agg(F.count("*").alias("n"), F.round(error, 3).alias("mae"))


@query()
def gbt_eta(s, d):
    """Errors of boosted trees on vessels they haven't seen; the model is saved and read again. Trees depend on how rows are dealt."""
    rows, folder = saved(_sequences(s, d).select("mmsi", "split", "y", *eta.FEATURES), "sequences"), files.scratch(s, "model")
    eta.train(rows).write().save(folder)
    return eta.report(rows, eta.GBTRegressionModel.load(folder))


ISO = ["gap_h", "dist_km", "implied_kn", "sog_before", "hour0", "abs_lat"]


def _scored(s, d) -> DataFrame:
    """Gaps with both flags, as a table: the threshold needs all scores before any row is judged."""
    found = forest.scored(saved(_dark(s, d).withColumn("abs_lat", F.abs("lat0")), "gaps"), ISO, F.col("event_id"))
    return found.withColumn("dark", F.col("rule_flag") | F.col("iso_anomaly"))


@query()
def iso_scores(s, d):
    return _scored(s, d).select("event_id", "mmsi", "t_start", "iso_score", "iso_anomaly")


@query()
def dark_detect(s, d):
    """Gaps that the rule or the forest calls dark."""
    return _scored(s, d).where("dark").select("event_id", "mmsi", "t_start", "t_end", "rule_flag", "iso_anomaly", "iso_score")


@query()
def dark_by_score(s, d):
    """The report of the oddest dark gaps."""
    return _scored(s, d).where("dark").orderBy(F.desc("iso_score"), "mmsi", "t_start").limit(50).select("mmsi", "t_start", "iso_score")


@query()
def dark_watchlist(s, d):
    return _scored(s, d).where("dark").select("mmsi", "t_start", "gap_h", "dist_km", "hour0")


COVER = "count(*) FILTER (WHERE EXISTS (SELECT 1 FROM dark WHERE rule_flag AND dark.mmsi = truth.mmsi AND t_start <= anchor AND t_end >= until))"


@query(f"SELECT CASE WHEN count(*) = 0 THEN 'NaN'::DOUBLE ELSE round({COVER} / count(*), 4) END AS recall FROM truth", f"{INJECT}, {sql.gaps_of('kept')}")
def recall_ratio(s, d):
    src = saved(_source(s, d), "source")
    found = injection.recall(*injection.blacked_out(src, injection.anchors(src, 8)))
    return found.select(R4(injection.ratio()).alias("recall"))


@query("SELECT 'NaN'::DOUBLE AS recall")
def recall_without_truth(s, d):
    src = _source(s, d)
    return injection.recall(src, injection.anchors(src, 8).where("false")).select(R4(injection.ratio()).alias("recall"))


@query(f"SELECT mmsi, coalesce(round(max({sql.hav('la', 'lo', 'lat', 'lon')}), 4), 0) AS longest_km, count(*) AS n FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM lens WINDOW w AS (PARTITION BY mmsi ORDER BY sec, event_id)) GROUP BY 1")
def grouped_python(s, d):
    """One Python body for each vessel, where a window can't say it; a vessel's track is held by its task."""
    return lens.pings(s, d).select("mmsi", "sec", "event_id", "lat", "lon").groupBy("mmsi").applyInPandas(track.longest_leg, "mmsi long, longest_km double, n long").withColumn("longest_km", R4("longest_km"))
