"""Named queries over the lens, each with the SQL text that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo, scalar
from wakeline.operators import injection, proximity, ranked, track
from wakeline.plans import lens, sql
from wakeline.sources import files
from wakeline.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
GRID = geo.HexGrid()
R4 = lambda c: F.round(c, 4)


def query(text: str | None = None, stages: str = sql.LENS):
    """Registers a query; text is the SQL of its result over the stages."""

    def put(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = f"WITH {stages} {text}"
        return f

    return put


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table, where several branches read it."""
    path = files.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _silver(s, d) -> DataFrame:
    return track.silver(lens.pings(s, d), lens.BOX)


def _inside(df: DataFrame) -> DataFrame:
    return df.withColumn("inside", geo.in_rings(F.col("lat"), F.col("lon"), geo.box_edges(*lens.PORT)))


def _eta(s, d) -> DataFrame:
    return track.eta_label(track.next_arrival(track.entries(_inside(_silver(s, d)))))


def _gaps(s, d) -> DataFrame:
    return track.gaps(lens.pings(s, d))


def _dark(s, d) -> DataFrame:
    return track.dark_candidates(_gaps(s, d))


def _port_km() -> Column:
    return geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(lens.POINT[0]), F.lit(lens.POINT[1]))


@query("SELECT count(*) AS n, count(DISTINCT mmsi) AS n_vessels FROM lens")
def scan_count(s, d):
    return lens.pings(s, d).agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("n_vessels"))


@query("SELECT mmsi, sec, round(lat, 4) AS lat, round(lon, 4) AS lon FROM lens")
def scan_projected(s, d):
    return lens.pings(s, d).select("mmsi", "sec", R4("lat").alias("lat"), R4("lon").alias("lon"))


@query("SELECT event_id, mmsi, sec FROM clip", sql.CLIP)
def bbox_clip(s, d):
    return track.clip(lens.pings(s, d), *lens.BOX).select("event_id", "mmsi", "sec")


@query("SELECT count(*) AS n, count(sog) AS n_sog, count(cog) AS n_cog, count(heading) AS n_heading FROM nulled", sql.NULLED)
def sentinel_null(s, d):
    return track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)).agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in ("sog", "cog", "heading")))


@query("SELECT event_id, mmsi::VARCHAR || '|' || coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, '') || '|' || coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE event_type END, '') AS vessel_uid FROM lens")
def vessel_uid(s, d):
    t = F.col("event_type")
    return lens.pings(s, d).select("event_id", scalar.identity(F.col("mmsi"), F.nullif(t, F.lit("view")), F.nullif(t, F.lit("click"))).alias("vessel_uid"))


@query("SELECT event_id, (sec // 86400)::INTEGER AS day, (sec % 86400 // 3600)::INTEGER AS hour FROM lens")
def date_parts(s, d):
    return lens.pings(s, d).select("event_id", F.floor(F.col("sec") / 86400).cast("int").alias("day"), F.floor(F.col("sec") % 86400 / 3600).cast("int").alias("hour"))


@query("SELECT mmsi, sum(dt_s)::BIGINT AS dt_s FROM (SELECT mmsi, sec - lag(sec) OVER (PARTITION BY mmsi ORDER BY sec, event_id) AS dt_s FROM lens) GROUP BY 1")
def time_delta(s, d):
    return lens.pings(s, d).withColumn("dt_s", F.col("sec") - F.lag("sec").over(track.by_vessel())).groupBy("mmsi").agg(F.sum("dt_s").alias("dt_s"))


@query("SELECT mmsi, hour, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, hour ORDER BY lat, lon, event_id) AS rn FROM (SELECT *, sec // 3600 AS hour FROM lens)) WHERE rn = 1")
def dedup_pings(s, d):
    hourly = lens.pings(s, d).withColumn("sec", F.floor(F.col("sec") / 3600))
    return track.deduplicated(hourly).select("mmsi", F.col("sec").alias("hour"), "event_id")


@query("SELECT event_id, dt_s, round(dist_km, 4) AS dist_km, gap_flag FROM seg", sql.SEG)
def trajectory_segments(s, d):
    return track.segments(track.deduplicated(track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)))).select("event_id", "dt_s", R4("dist_km").alias("dist_km"), "gap_flag")


@query("SELECT event_id, round(implied_kn, 4) AS implied_kn FROM seg", sql.SEG)
def implied_speed(s, d):
    return track.segments(track.deduplicated(track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)))).select("event_id", R4("implied_kn").alias("implied_kn"))


@query("SELECT count(*) AS n, round(sum(dist_km), 4) AS km, count(implied_kn) AS n_kn, count(*) FILTER (WHERE gap_flag) AS n_gap, sum(dt_s)::BIGINT AS dt_s FROM silver", sql.SILVER)
def jump_filter(s, d):
    return _silver(s, d).agg(F.count("*").alias("n"), R4(F.sum("dist_km")).alias("km"), F.count("implied_kn").alias("n_kn"), F.count_if("gap_flag").alias("n_gap"), F.sum("dt_s").alias("dt_s"))


@query("SELECT (SELECT count(*) FROM lens) AS n_bronze, (SELECT count(*) FROM clip) AS n_clip, (SELECT count(*) FROM dedup) AS n_dedup, (SELECT count(*) FROM silver) AS n_silver", sql.SILVER)
def stage_counts(s, d):
    """One pass: each row carries how far it got."""
    x1, y1, x2, y2 = lens.BOX
    near = F.coalesce(F.col("lon").between(x1, x2) & F.col("lat").between(y1, y2) & F.col("mmsi").isNotNull() & F.col("sec").isNotNull(), F.lit(False))
    p = lens.pings(s, d).repartition("mmsi").withColumn("near", near)
    first = F.row_number().over(Window.partitionBy("mmsi", "near", "sec").orderBy("lat", "lon", "event_id")) == 1
    p = p.withColumn("single", F.col("near") & first)
    w = Window.partitionBy("mmsi", "single").orderBy("sec", "event_id")
    km = geo.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    p = p.withColumn("kn", geo.speed_kn(F.coalesce(km, F.lit(0.0)), F.col("sec") - F.lag("sec").over(w)))
    kept = F.col("single") & (F.col("kn").isNull() | (F.col("kn") <= track.JUMP_KN))
    return p.agg(F.count("*").alias("n_bronze"), F.count_if("near").alias("n_clip"), F.count_if("single").alias("n_dedup"), F.count_if(kept).alias("n_silver"))


@query("SELECT count(DISTINCT mmsi) AS n_vessels FROM silver", sql.SILVER)
def n_vessels(s, d):
    return _silver(s, d).agg(F.count_distinct("mmsi").alias("n_vessels"))


@query("SELECT count(*) AS n FROM (SELECT mmsi FROM lens WHERE event_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_type) > 1)")
def multi_identity(s, d):
    by = lens.pings(s, d).where("event_type IS NOT NULL").groupBy("mmsi").agg(F.count_distinct("event_type").alias("k"))
    return by.where("k > 1").agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT mmsi) AS n_vessels, count(*) AS n_points, round(sum(km), 4) AS km FROM (SELECT mmsi, coalesce({sql.hav('la', 'lo', 'lat', 'lon')}, 0) AS km FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM lens WINDOW w AS (PARTITION BY mmsi ORDER BY sec, event_id)))")
def trajectory_summary(s, d):
    """Vessels, pings and kilometres; the sums by vessel need no shuffle after the window's."""
    w = track.by_vessel()
    km = F.coalesce(geo.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    by = lens.pings(s, d).select("mmsi", km.alias("km")).groupBy("mmsi").agg(F.count("*").alias("n"), F.sum("km").alias("km"))
    return by.agg(F.count("mmsi").alias("n_vessels"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"), R4(F.sum("km")).alias("km"))


@query(f"SELECT event_id, round({sql.hav('lat', 'lon', '34.0', '-118.0')}, 4) AS km FROM lens")
def haversine(s, d):
    return lens.pings(s, d).select("event_id", R4(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(34.0), F.lit(-118.0))).alias("km"))


@query("SELECT event_id, round(value, 1) AS half_up, round_even(value * 2, 0) / 2 AS half_even FROM lens")
def rounding(s, d):
    return lens.pings(s, d).select("event_id", F.round("value", 1).alias("half_up"), (F.bround(F.col("value") * 2, 0) / 2).alias("half_even"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE NOT isnan(v)) AS n_number, round(sum(CASE WHEN isnan(v) THEN 0 ELSE v END), 4) AS total FROM (SELECT CASE WHEN event_type = 'view' THEN 'NaN'::DOUBLE ELSE value END AS v FROM lens)")
def nan_handling(s, d):
    v = F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value"))
    return lens.pings(s, d).select(v.alias("v")).agg(F.count("*").alias("n"), F.count_if(~F.isnan("v")).alias("n_number"), R4(F.sum(F.nanvl("v", F.lit(0.0)))).alias("total"))


@query("SELECT event_id FROM nulled WHERE sog IS NOT NULL AND heading IS NOT NULL", sql.NULLED)
def dropna_subset(s, d):
    return track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)).na.drop(subset=["sog", "heading"]).select("event_id")


@query("SELECT round(sum(coalesce(sog, 0)), 4) AS sog, round(sum(coalesce(heading, 0)), 4) AS heading FROM nulled", sql.NULLED)
def fillna_features(s, d):
    return track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)).na.fill(0.0, ["sog", "heading"]).agg(R4(F.sum("sog")).alias("sog"), R4(F.sum("heading")).alias("heading"))


@query("SELECT mmsi, sec, row_number() OVER (PARTITION BY mmsi ORDER BY sec, event_id)::INTEGER AS place FROM lens")
def sort_track(s, d):
    return lens.pings(s, d).select("mmsi", "sec", F.row_number().over(track.by_vessel()).alias("place"))


@query(f"SELECT event_id, cell FROM ({sql.HEX % 'lens'})")
def hex_cell(s, d):
    return lens.pings(s, d).select("event_id", GRID.cell(F.col("lat"), F.col("lon")).alias("cell"))


@query(f"SELECT DISTINCT cell, (split_part(cell, ':', 1)::INTEGER + a)::VARCHAR || ':' || (split_part(cell, ':', 2)::INTEGER + b)::VARCHAR AS near FROM ({sql.HEX % 'lens'}), (VALUES (0, 0), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)) AS k(a, b)")
def hex_disk(s, d):
    return hex_cell(s, d).select("cell").distinct().select("cell", F.explode(GRID.disk(F.col("cell"))).alias("near"))


@query(f"SELECT cell, k::INTEGER AS corner, round(33.7 + (1.4::DOUBLE * 1.5 * r + 1.4::DOUBLE * sin(radians(60 * k + 30))) / 110.57::DOUBLE, 4) AS lat, round(-118.2 + (1.4::DOUBLE * sqrt(3::DOUBLE) * (q + r / 2) + 1.4::DOUBLE * cos(radians(60 * k + 30))) / {sql.KLON!r}::DOUBLE, 4) AS lon FROM (SELECT DISTINCT cell, split_part(cell, ':', 1)::DOUBLE AS q, split_part(cell, ':', 2)::DOUBLE AS r FROM ({sql.HEX % 'lens'})), range(6) AS t(k)")
def hex_boundary(s, d):
    ring = hex_cell(s, d).select("cell").distinct().select("cell", F.posexplode(GRID.corners(F.col("cell"))).alias("corner", "at"))
    return ring.select("cell", "corner", R4("at.lat").alias("lat"), R4("at.lon").alias("lon"))


@query(f"SELECT count(DISTINCT cell) AS n_cells FROM ({sql.HEX % 'lens'})")
def n_cells(s, d):
    return hex_cell(s, d).agg(F.count_distinct("cell").alias("n_cells"))


@query(f"SELECT * FROM (VALUES ({sql.GX}::DOUBLE, {sql.GY}::DOUBLE, {sql.GX2}::DOUBLE, {sql.GY}::DOUBLE), ({sql.GX2}, {sql.GY}, {sql.GX2}, {sql.GY2}), ({sql.GX2}, {sql.GY2}, {sql.GX}, {sql.GY2}), ({sql.GX}, {sql.GY2}, {sql.GX}, {sql.GY})) AS t(x1, y1, x2, y2)")
def port_edges(s, d):
    return s.createDataFrame(geo.box_edges(*lens.PORT), "x1 double, y1 double, x2 double, y2 double")


@query(f"SELECT event_id, {sql.PIP} AS inside FROM lens")
def point_in_polygon(s, d):
    return _inside(lens.pings(s, d)).select("event_id", "inside")


@query(f"SELECT round(({sql.GX}::DOUBLE + {sql.GX2}::DOUBLE) / 2, 4) AS lon, round(({sql.GY}::DOUBLE + {sql.GY2}::DOUBLE) / 2, 4) AS lat")
def polygon_centroid(s, d):
    """Area centroid by the shoelace sum."""
    e = port_edges(s, d).withColumn("a", F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    sums = e.agg(F.sum("a").alias("a"), F.sum((F.col("x1") + F.col("x2")) * F.col("a")).alias("x"), F.sum((F.col("y1") + F.col("y2")) * F.col("a")).alias("y"))
    return sums.select(R4(F.col("x") / F.col("a") / 3).alias("lon"), R4(F.col("y") / F.col("a") / 3).alias("lat"))


@query(f"SELECT event_id, round({sql.DIST}, 4) AS km FROM silver", sql.SILVER)
def port_distance(s, d):
    return _silver(s, d).select("event_id", R4(_port_km()).alias("km"))


@query(f"SELECT event_id, round({sql.BEAR}, 4) AS deg FROM lens")
def port_bearing(s, d):
    return lens.pings(s, d).select("event_id", R4(geo.bearing_deg(F.col("lat"), F.col("lon"), F.lit(lens.POINT[0]), F.lit(lens.POINT[1]))).alias("deg"))


@query("SELECT mmsi, sec FROM entry WHERE entry", sql.ENTRY)
def port_entries(s, d):
    return track.entries(_inside(_silver(s, d))).where("entry").select("mmsi", "sec")


@query("SELECT event_id, arrival FROM reach", sql.ASOF)
def asof_next_arrival(s, d):
    return track.next_arrival(track.entries(_inside(_silver(s, d)))).select("event_id", "arrival")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM lens")
def asof_static_backward(s, d):
    return track.last_known(lens.pings(s, d), F.when(F.col("event_type") == "signup", F.col("event_id")), "latest").select("event_id", "latest")


@query("SELECT event_id, round(eta_min, 4) AS eta_min, has_eta FROM eta", sql.ETA)
def eta_label(s, d):
    return _eta(s, d).select("event_id", R4("eta_min").alias("eta_min"), "has_eta")


@query(f"SELECT event_id, mmsi, sec, dt_s, round(dist_km, 4) AS dist_km, gap_flag, cell, round({sql.DIST}, 4) AS port_km, round({sql.BEAR}, 4) AS port_deg, inside, round(eta_min, 4) AS eta_min, has_eta FROM ({sql.HEX % 'eta'})", sql.ETA)
def gold(s, d):
    at = F.col("lat"), F.col("lon")
    return _eta(s, d).select("event_id", "mmsi", "sec", "dt_s", R4("dist_km").alias("dist_km"), "gap_flag", GRID.cell(*at).alias("cell"), R4(_port_km()).alias("port_km"), R4(geo.bearing_deg(*at, F.lit(lens.POINT[0]), F.lit(lens.POINT[1]))).alias("port_deg"), "inside", R4("eta_min").alias("eta_min"), "has_eta")


@query("SELECT round(quantile_cont(eta_min, 0.25), 4) AS p25, round(quantile_cont(eta_min, 0.5), 4) AS p50, round(quantile_cont(eta_min, 0.75), 4) AS p75, round(quantile_cont(eta_min, 0.9), 4) AS p90 FROM eta WHERE arrival IS NOT NULL", sql.ETA)
def eta_quantiles(s, d):
    rows = ranked.quantiles(_eta(s, d).where("arrival IS NOT NULL"), "eta_min", [0.25, 0.5, 0.75, 0.9])
    return _by_share(rows, (25, 50, 75, 90))


def _by_share(rows: DataFrame, percents: tuple[int, ...]) -> DataFrame:
    """(share, value) as one row of columns."""
    return rows.agg(*(R4(F.max(F.when(F.round(F.col("share") * 100) == p, F.col("value")))).alias(f"p{p}") for p in percents))


@query("SELECT least(47, floor(eta_min / 15))::INTEGER AS bin, count(*) AS n FROM eta WHERE has_eta GROUP BY 1", sql.ETA)
def eta_histogram(s, d):
    return _eta(s, d).where("has_eta").groupBy(F.least(F.lit(47), F.floor(F.col("eta_min") / 15)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


TRAFFIC = f"(SELECT cell, count(*) AS traffic, round(avg(eta_min) FILTER (WHERE has_eta), 0) AS avg_eta FROM ({sql.HEX % 'eta'}) GROUP BY 1)"


def _traffic(s, d) -> DataFrame:
    at = _eta(s, d).withColumn("cell", GRID.cell(F.col("lat"), F.col("lon")))
    return at.groupBy("cell").agg(F.count("*").alias("traffic"), F.round(F.avg(F.when(F.col("has_eta"), F.col("eta_min"))), 0).alias("avg_eta"))


@query(f"SELECT * FROM {TRAFFIC}", sql.ETA)
def hex_traffic_eta(s, d):
    return _traffic(s, d)


@query(f"SELECT cell, round_even(traffic * 1400 / (SELECT max(traffic) FROM {TRAFFIC})::DOUBLE, 0)::INTEGER AS elev FROM {TRAFFIC}", sql.ETA)
def hex_elevation(s, d):
    t = saved(_traffic(s, d), "traffic")
    return t.crossJoin(F.broadcast(t.agg(F.max("traffic").alias("top")))).select("cell", F.bround(F.col("traffic") * 1400 / F.col("top").cast("double"), 0).cast("int").alias("elev"))


@query("SELECT round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM lens")
def color_bounds(s, d):
    return _by_share(ranked.quantiles(lens.pings(s, d), "value", [0.05, 0.95, 0.99]), (5, 95, 99))


@query("SELECT event_id, floor(greatest(0, least(1, (coalesce(sog, 0) - 0) / 30::DOUBLE)) * 255)::INTEGER AS shade FROM nulled", sql.NULLED)
def color_scale(s, d):
    return track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)).select("event_id", scalar.shade(F.col("sog"), 0.0, 30.0).alias("shade"))


PORT_CELLS = f"(SELECT cell, count(*) AS n FROM ({sql.HEX % 'ins'}) WHERE inside GROUP BY 1)"


@query(f"SELECT * FROM {PORT_CELLS}", sql.INSIDE)
def port_cells(s, d):
    return _inside(_silver(s, d)).where("inside").groupBy(GRID.cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count("*").alias("n"))


@query(f"SELECT cell, n FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, cell) - n AS before, sum(n) OVER () AS total FROM {PORT_CELLS}) WHERE before < 0.9::DOUBLE * total", sql.INSIDE)
def coverage_cut(s, d):
    """Busiest cells up to 90 % of the pings."""
    return ranked.busiest(port_cells(s, d), 0.9)


GAP_COLS = ("mmsi", "t_start", "t_end", "hour0")


@query("SELECT mmsi, t_start, t_end, hour0, round(gap_h, 4) AS gap_h, round(dist_km, 4) AS dist_km, round(sog_before, 4) AS sog_before FROM gaps", sql.GAPS)
def gap_extract(s, d):
    return _gaps(s, d).select(*GAP_COLS, *(R4(c).alias(c) for c in ("gap_h", "dist_km", "sog_before")))


@query("SELECT mmsi, t_start, rule_flag, round(implied_kn, 4) AS implied_kn FROM dark", sql.GAPS)
def dark_rules(s, d):
    return _dark(s, d).select("mmsi", "t_start", "rule_flag", R4("implied_kn").alias("implied_kn"))


@query("SELECT mmsi, t_start, round(gap_h, 4) AS gap_h, round(coalesce(sog_before, 0), 4) AS sog_before, round(abs(lat0), 4) AS abs_lat, hour0 FROM dark", sql.GAPS)
def iso_features(s, d):
    return _dark(s, d).select("mmsi", "t_start", R4("gap_h").alias("gap_h"), R4(F.coalesce("sog_before", F.lit(0.0))).alias("sog_before"), R4(F.abs("lat0")).alias("abs_lat"), "hour0")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE rule_flag) AS n_rule, count(*) FILTER (WHERE gap_h > 24) AS n_day FROM dark", sql.GAPS)
def dark_stats(s, d):
    return _dark(s, d).agg(F.count("*").alias("n"), F.count_if("rule_flag").alias("n_rule"), F.count_if(F.col("gap_h") > 24).alias("n_day"))


@query("SELECT mmsi, t_start, rule_flag OR gap_h > 40 AS dark FROM dark WHERE rule_flag OR gap_h > 40", sql.GAPS)
def dark_combine(s, d):
    """Either flag is enough; the second is a plain threshold here."""
    return _dark(s, d).withColumn("dark", F.col("rule_flag") | (F.col("gap_h") > 40)).where("dark").select("mmsi", "t_start", "dark")


@query("SELECT mmsi, t_start, round(gap_h, 4) AS gap_h FROM dark ORDER BY dark.gap_h DESC, mmsi, t_start LIMIT 50", sql.GAPS)
def dark_topk(s, d):
    return _dark(s, d).orderBy(F.desc("gap_h"), "mmsi", "t_start").limit(50).select("mmsi", "t_start", R4("gap_h").alias("gap_h"))


@query("SELECT mmsi, t_start, (1500 + greatest(0, least(72, gap_h)) * 400)::INTEGER AS radius FROM (SELECT mmsi, t_start, floor(gap_h) AS gap_h FROM dark)", sql.GAPS)
def dark_radius(s, d):
    return _dark(s, d).select("mmsi", "t_start", (1500 + F.greatest(F.lit(0.0), F.least(F.lit(72.0), F.floor("gap_h").cast("double"))) * 400).cast("int").alias("radius"))


@query("SELECT mmsi, t_start, round(dist_km, 4) AS dist_km, round(gap_h, 4) AS gap_h, hour0 FROM dark WHERE rule_flag", sql.GAPS)
def watchlist(s, d):
    return _dark(s, d).where("rule_flag").select("mmsi", "t_start", R4("dist_km").alias("dist_km"), R4("gap_h").alias("gap_h"), "hour0")


MOVERS = "picked AS (SELECT mmsi, count(*) AS n FROM lens WHERE sog BETWEEN 3 AND 30 GROUP BY 1 HAVING count(*) > 20 ORDER BY md5('42' || mmsi::VARCHAR), mmsi LIMIT 60)"
INJECT = f"""{sql.LENS}, {MOVERS}, src AS (SELECT * FROM lens WHERE mmsi IN (SELECT mmsi FROM picked)),
able AS (SELECT * FROM (SELECT *, max(sec) OVER (PARTITION BY mmsi) AS last FROM src) WHERE sog >= 3 AND sec <= last - 28800),
cuts AS (SELECT mmsi, sec AS anchor, sec + 28800 AS until FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY md5('42' || event_id::VARCHAR), event_id) AS rn FROM able) WHERE rn = 1),
kept AS (SELECT * FROM src WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.mmsi = src.mmsi AND src.sec > anchor AND src.sec <= until)),
truth AS (SELECT * FROM cuts WHERE EXISTS (SELECT 1 FROM src WHERE cuts.mmsi = src.mmsi AND src.sec > anchor AND src.sec <= until))"""


def _source(s, d) -> DataFrame:
    p = lens.pings(s, d)
    return p.join(injection.dense_movers(p, 20, 60).select("mmsi"), "mmsi", "left_semi")


@query("SELECT * FROM picked", f"{sql.LENS}, {MOVERS}")
def dense_movers(s, d):
    return injection.dense_movers(lens.pings(s, d), 20, 60)


@query("SELECT event_id FROM lens ORDER BY md5('7' || event_id::VARCHAR), event_id LIMIT 500")
def hash_sample(s, d):
    return lens.pings(s, d).orderBy(scalar.sample_key(7, F.col("event_id")), "event_id").limit(500).select("event_id")


@query("SELECT mmsi, count(*) AS n, max(sec) - min(sec) AS span_s FROM lens GROUP BY 1")
def grouped_map(s, d):
    return lens.pings(s, d).groupBy("mmsi").agg(F.count("*").alias("n"), (F.max("sec") - F.min("sec")).alias("span_s"))


@query("SELECT event_id, mmsi FROM src", INJECT)
def inject_source(s, d):
    return _source(s, d).select("event_id", "mmsi")


@query("SELECT * FROM cuts", INJECT)
def inject_anchor(s, d):
    return injection.anchors(_source(s, d), 8)


@query("SELECT event_id, mmsi FROM kept", INJECT)
def inject_blackouts(s, d):
    src = _source(s, d)
    return injection.blacked_out(src, injection.anchors(src, 8))[0].select("event_id", "mmsi")


@query("SELECT count(*) AS n_truth, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM dark WHERE rule_flag AND dark.mmsi = truth.mmsi AND t_start <= anchor AND t_end >= until)) AS n_hit FROM truth", f"{INJECT}, {sql.gaps_of('kept')}")
def recall_cover(s, d):
    src = saved(_source(s, d), "source")
    return injection.recall(*injection.blacked_out(src, injection.anchors(src, 8)))


FINE = geo.HexGrid(0.2)
RADAR = f"{sql.LENS}, cells AS ({sql.hexed('lens', '0.2')}), seen AS (SELECT DISTINCT (split_part(cell, ':', 1)::INTEGER + a)::VARCHAR || ':' || (split_part(cell, ':', 2)::INTEGER + b)::VARCHAR AS near FROM cells, (VALUES (0, 0), (1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)) AS k(a, b) WHERE event_type = 'signup'), radar AS (SELECT event_id, cell, NOT EXISTS (SELECT 1 FROM seen WHERE near = cell) AS dark FROM cells WHERE event_type = 'purchase')"


def _radar(s, d, some: bool = True) -> DataFrame:
    p = lens.pings(s, d)
    reports = p.where((F.col("event_type") == "signup") & F.lit(some))
    return proximity.corroborated(p.where("event_type = 'purchase'"), reports, FINE)


@query("SELECT event_id, cell, dark FROM radar", RADAR)
def sar_cross(s, d):
    return _radar(s, d).select("event_id", "cell", "dark")


@query("SELECT event_id FROM radar WHERE dark", RADAR)
def sar_dark_anti(s, d):
    return _radar(s, d).where("dark").select("event_id")


@query("SELECT event_id FROM radar WHERE NOT dark", RADAR)
def sar_corroborated_semi(s, d):
    return _radar(s, d).where("NOT dark").select("event_id")


@query("SELECT event_id, false AS dark FROM lens WHERE event_type = 'purchase'")
def sar_cross_empty_ref(s, d):
    return _radar(s, d, False).select("event_id", "dark")


@query("SELECT event_id, CASE WHEN dark THEN 255 ELSE 60 END::INTEGER AS r, CASE WHEN dark THEN 900 ELSE 500 END::INTEGER AS radius, CASE WHEN dark THEN 'dark' ELSE 'seen' END AS label FROM radar", RADAR)
def sar_style(s, d):
    pick = lambda a, b: F.when(F.col("dark"), F.lit(a)).otherwise(F.lit(b))
    return _radar(s, d).select("event_id", pick(255, 60).alias("r"), pick(900, 500).alias("radius"), pick("dark", "seen").alias("label"))


@query("SELECT count(*) AS n FROM lens WHERE sec >= (SELECT max(sec) FROM lens) - 30 * 86400")
def rolling_30d(s, d):
    """Scheduled moving window of the last 30 days."""
    p = lens.pings(s, d)
    return p.crossJoin(F.broadcast(p.agg(F.max("sec").alias("end")))).where("sec >= end - 30 * 86400").agg(F.count("*").alias("n"))


HEXDIGIT = "(" + " + ".join(f"(strpos('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {pow(16, 31 - i, 100)}" for i in range(32)) + ") % 100"


@query(f"SELECT mmsi, ({HEXDIGIT})::BIGINT AS bucket, CASE WHEN {HEXDIGIT} < 70 THEN 'train' WHEN {HEXDIGIT} < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT mmsi, md5(mmsi::VARCHAR) AS h FROM lens)")
def md5_split(s, d):
    b = lens.pings(s, d).select("mmsi").distinct().withColumn("bucket", scalar.md5_bucket(F.col("mmsi")))
    return b.withColumn("split", scalar.split_name(F.col("bucket")))


@query("SELECT event_id, round(cos(radians(coalesce(cog, 0))), 4) AS c, round(sin(radians(coalesce(cog, 0))), 4) AS s FROM nulled", sql.NULLED)
def angle_encode(s, d):
    c, n = scalar.angle(F.col("cog"))
    return track.without_sentinels(track.clip(lens.pings(s, d), *lens.BOX)).select("event_id", R4(c).alias("c"), R4(n).alias("s"))


@query("SELECT event_id, round(ln(1 + eta_min), 4) AS y, round(exp(ln(1 + eta_min)) - 1, 4) AS back FROM eta WHERE has_eta", sql.ETA)
def log_target(s, d):
    return _eta(s, d).where("has_eta").select("event_id", R4(F.log1p("eta_min")).alias("y"), R4(F.expm1(F.log1p("eta_min"))).alias("back"))


STEPS = f"{sql.ETA}, win AS (SELECT *, count(*) OVER w AS k, list(coalesce(sog, 0)) OVER w AS sogs FROM eta WINDOW w AS (PARTITION BY mmsi ORDER BY sec, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)), full_win AS (SELECT * FROM win WHERE k = 16 AND has_eta), el AS (SELECT unnest(sogs) AS x FROM full_win)"


def _steps(s, d) -> DataFrame:
    return track.sequences(_eta(s, d).withColumn("x", F.coalesce("sog", F.lit(0.0))), ["x", "dist_km"])


@query("SELECT event_id, 16::INTEGER AS k, round(list_sum(sogs), 4) AS total FROM full_win", STEPS)
def seq_windows(s, d):
    return _steps(s, d).select("event_id", F.size("steps").alias("k"), R4(F.aggregate("steps", F.lit(0.0), lambda a, v: a + v["x"])).alias("total"))


@query("SELECT count(*) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std FROM el", STEPS)
def train_scaler(s, d):
    return _steps(s, d).select(F.explode("steps").alias("v")).agg(F.count("*").alias("n"), R4(F.avg("v.x")).alias("mean"), R4(F.stddev_pop("v.x")).alias("std"))


@query("SELECT event_id, round((x - m) / (sd + 1e-6), 4) AS z FROM (SELECT event_id, coalesce(sog, 0) AS x FROM full_win), (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM el)", STEPS)
def standardize(s, d):
    w = _steps(s, d)
    one = w.select(F.explode("steps").alias("v")).agg(F.avg("v.x").alias("m"), F.stddev_pop("v.x").alias("sd"))
    return w.crossJoin(F.broadcast(one)).select("event_id", R4((F.col("x") - F.col("m")) / (F.col("sd") + 1e-6)).alias("z"))


@query(f"SELECT count(*) AS n, round(avg(abs(eta_min - {sql.DIST} / (greatest(coalesce(sog, 0), 0.5) * 1.852) * 60)), 4) AS mae FROM full_win", STEPS)
def naive_eta_mae(s, d):
    guess = _port_km() / (F.greatest(F.col("x"), F.lit(0.5)) * 1.852) * 60
    return _steps(s, d).select(F.abs(F.col("eta_min") - guess).alias("e")).agg(F.count("*").alias("n"), R4(F.avg("e")).alias("mae"))


@query("SELECT event_id, sha256(event_type || ':' || event_id::VARCHAR) AS digest FROM lens")
def sha256_text(s, d):
    return lens.pings(s, d).select("event_id", F.sha2(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), 256).alias("digest"))


@query("SELECT event_id, 'https://example.org/' || (1970 + sec // 31557600)::VARCHAR || '/AIS_' || event_type || '.zip' AS url FROM lens")
def url_build(s, d):
    return lens.pings(s, d).select("event_id", F.format_string("https://example.org/%d/AIS_%s.zip", 1970 + F.floor(F.col("sec") / 31557600), F.col("event_type")).alias("url"))


@query("SELECT event_id, (sog::FLOAT)::DOUBLE AS f32, trunc(value)::INTEGER AS whole, TRY_CAST(event_type AS INTEGER) AS bad FROM lens")
def cast_types(s, d):
    return lens.pings(s, d).select("event_id", F.col("sog").cast("float").cast("double").alias("f32"), F.col("value").cast("int").alias("whole"), F.expr("try_cast(event_type AS int)").alias("bad"))


@query("SELECT event_id, mmsi FROM lens")
def union_days(s, d):
    p = lens.pings(s, d)
    parts = [p.where(F.floor(F.col("sec") / 86400) % 2 == k) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("event_id", "mmsi")


PLAIN = "SELECT event_id, mmsi, sec, round(lat, 4) AS lat, nullif(event_type, 'view') AS event_type FROM lens"
PLAIN_SCHEMA = "event_id long, mmsi long, sec long, lat double, event_type string"


def _plain(s, d) -> DataFrame:
    kept = lens.pings(s, d).select("event_id", "mmsi", "sec", R4("lat").alias("lat"), F.nullif("event_type", F.lit("view")).alias("event_type"))
    return kept.select(*(F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in PLAIN_SCHEMA.split(", "))))


@query(PLAIN)
def csv_roundtrip(s, d):
    path = files.scratch(s, "csv")
    _plain(s, d).write.option("header", True).csv(path)
    return files.read_csv(s, path, PLAIN_SCHEMA)


@query(PLAIN)
def json_roundtrip(s, d):
    path = files.scratch(s, "json")
    _plain(s, d).write.json(path)
    return s.read.schema(PLAIN_SCHEMA).json(path)


@query("SELECT event_id, mmsi, (sec // 86400)::INTEGER AS day FROM lens")
def hive_partition_roundtrip(s, d):
    path = files.scratch(s, "hive")
    files.write_by(lens.pings(s, d).select("event_id", "mmsi", F.floor(F.col("sec") / 86400).cast("int").alias("day")), path, "day")
    return s.read.parquet(path).select("event_id", "mmsi", "day")


@query("SELECT event_id, mmsi, (sec // 86400)::INTEGER AS day FROM lens WHERE sec // 86400 > (SELECT (min(sec) + max(sec)) // 2 // 86400 FROM lens)")
def hive_pruned_scan(s, d):
    """The filter on the partition column is the feature: folders of the first half aren't read."""
    path = files.scratch(s, "hive")
    p = lens.pings(s, d).select("event_id", "mmsi", "sec", F.floor(F.col("sec") / 86400).cast("int").alias("day"))
    files.write_by(p.drop("sec"), path, "day")
    middle = p.agg(F.expr("(min(sec) + max(sec)) div 2 div 86400")).first()[0]
    return s.read.parquet(path).where(F.col("day") > middle).select("event_id", "mmsi", "day")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN sec END AS sec FROM lens")
def parse_live_time(s, d):
    p = lens.pings(s, d)
    at = F.expr("cast(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, sec) AS string)")
    text = F.when(F.col("event_type") == "error", F.lit("no time")).otherwise(F.concat(at, F.lit(".000000 +0000 UTC")))
    return p.select("event_id", live.live_time(text).alias("sec"))


def _messages(s, d) -> DataFrame:
    """Pings as live messages: signups are static reports, errors are of another kind."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "ShipStaticData").when(t == "error", "Other").otherwise("PositionReport")
    head = F.struct("mmsi", (F.col("lat") + 1).alias("latitude"))
    body = F.struct(F.when(t != "view", F.col("lat")).alias("Latitude"), (F.col("event_id") % 3).alias("ImoNumber"), F.when(t == "signup", F.col("event_id")).alias("Static"), F.col("event_id").alias("Seq"), F.col("sec").alias("Sec"))
    return lens.pings(s, d).select(F.to_json(F.struct(kind.alias("MessageType"), head.alias("MetaData"), body.alias("Message"))).alias("value"))


@query("SELECT event_id AS seq, mmsi, round(CASE WHEN event_type = 'view' THEN lat + 1 ELSE lat END, 4) AS lat, nullif(event_id % 3, 0) AS imo FROM lens WHERE event_type <> 'error'")
def json_extract(s, d):
    return live.parsed(_messages(s, d)).select("seq", "mmsi", R4("lat").alias("lat"), "imo")


def _stream(s, d) -> DataFrame:
    path = files.scratch(s, "messages")
    _messages(s, d).write.text(path)
    return live.parsed(s.readStream.text(path))


@query("SELECT event_id AS seq, mmsi FROM lens WHERE event_type NOT IN ('error', 'signup')")
def stream_positions(s, d):
    return live.landed(_stream(s, d).where("kind = 'PositionReport'").select("seq", "mmsi"), "positions")


@query("SELECT seq, mmsi, latest FROM (SELECT event_id AS seq, mmsi, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest, event_type FROM lens) WHERE event_type NOT IN ('error', 'signup')")
def stream_enrich(s, d):
    return live.landed(live.enriched(_stream(s, d)), "enriched")


@query("SELECT event_id AS seq, mmsi FROM lens WHERE event_type <> 'error'")
def stream_file_sink(s, d):
    return live.landed(_stream(s, d).select("seq", "mmsi"), "sink", seconds=1)
