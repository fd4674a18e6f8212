"""Every query of the core against its SQL, and the pieces that have no query."""

import hashlib
import http.server
import json
import threading
import time
import urllib.parse
import zipfile

import numpy as np
import pytest
from oracle_check import differences
from pyspark.sql import functions as F

from wakeline.functions import geo, scalar
from wakeline.ml import eta, forest
from wakeline.operators import ranked, track
from wakeline.plans import landing as landing_queries  # noqa: F401  registers its queries
from wakeline.plans import learning, queries, run
from wakeline.sources import files, geojson, landing
from wakeline.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF) == ""


def test_empty_result_keeps_the_last_one(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert files.write_unless_empty(spark.range(3), path)
    assert not files.write_unless_empty(spark.range(0), path)
    assert spark.read.parquet(path).count() == 3


def test_state_lasts_from_batch_to_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    line = '{"MessageType":"%s","MetaData":{"mmsi":1},"Message":{"Static":%s,"Seq":%d,"Sec":%d}}'
    spark.createDataFrame([(line % ("PositionReport", "null", 1, 1),), (line % ("ShipStaticData", "7", 2, 2),)], "value string").coalesce(1).write.text(src)
    spark.createDataFrame([(line % ("PositionReport", "null", 3, 3),)], "value string").coalesce(1).write.mode("append").text(src)
    stream = live.parsed(spark.readStream.option("maxFilesPerTrigger", 1).text(src))
    got = {r["seq"]: r["latest"] for r in live.landed(live.enriched(stream), "state").collect()}
    assert got == {1: None, 3: 7}


def test_forest_finds_planted_outliers(spark):
    """Far points score highest, the flagged share is as asked, and the same rows give the same scores."""
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(3000)] + [(5000 + i, 9.0 + i, -9.0, 9.0) for i in range(5)] + [(9000, None, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    got = {r["id"]: r for r in forest.scored(df, ["a", "b", "c"], F.col("id")).collect()}
    assert len(got) == len(rows)
    top = sorted(got, key=lambda i: -got[i]["iso_score"])[:5]
    assert sorted(top) == list(range(5000, 5005))
    assert 0.015 * len(rows) <= sum(r["iso_anomaly"] for r in got.values()) <= 0.02 * len(rows) + 1
    again = {r["id"]: r["iso_score"] for r in forest.scored(df.repartition(3), ["a", "b", "c"], F.col("id")).collect()}
    assert all(abs(again[i] - got[i]["iso_score"]) < 1e-12 for i in got)
    assert forest.scored(df.where("false"), ["a", "b", "c"], F.col("id")).count() == 0


def test_forest_depths():
    """Mean depths of all leaves agree with the closed form for random data."""
    assert forest.path_length(1) == 0 and forest.path_length(2) == 1 and abs(forest.path_length(256) - 10.24) < 0.01


def test_dark_by_rule_or_forest(spark):
    rows = learning._scored(spark, SF).collect()
    assert 0 < sum(r["iso_anomaly"] for r in rows) <= 0.02 * len(rows) + 1
    flagged = {r["event_id"] for r in rows if r["rule_flag"] or r["iso_anomaly"]}
    assert {r["event_id"] for r in queries.QUERIES["dark_detect"](spark, SF).collect()} == flagged
    report = [r["iso_score"] for r in queries.QUERIES["dark_by_score"](spark, SF).collect()]
    assert report == sorted(report, reverse=True) and len(report) == min(50, len(flagged))
    assert queries.QUERIES["dark_watchlist"](spark, SF).count() == len(flagged)


def test_trees_on_unseen_vessels(spark, tmp_path):
    """A learnable target is learned; model, scaler and metadata are read again."""
    rng = np.random.default_rng(1)
    rows = []
    for v in range(60):
        for _ in range(20):
            sog, km = rng.uniform(2, 20), rng.uniform(1, 50)
            rows.append((v, float(sog), float(km), float(np.log1p(km / (sog * 1.852) * 60)), *[0.0] * 8))
    names = ["sog", "port_km", "y", *(f for f in eta.FEATURES if f not in ("sog", "port_km"))]
    df = spark.createDataFrame(rows, "mmsi long, " + ", ".join(f"{n} double" for n in names))
    df = df.withColumn("split", scalar.split_name(scalar.md5_bucket(F.col("mmsi"))))
    model = eta.train(df)
    stats = spark.createDataFrame([("sog", 1.0, 2.0)], "feature string, mean double, std double")
    eta.save(model, stats, f"file://{tmp_path}/m")
    got = {r["split"]: r for r in eta.report(df, eta.load(f"file://{tmp_path}/m")).collect()}
    assert got["test"]["naive"] < 1e-6 and got["test"]["trees"] < 15
    assert spark.read.json(f"file://{tmp_path}/m/meta").first()["steps"] == 16


def test_gbt_query(spark):
    rows = queries.QUERIES["gbt_eta"](spark, "/root/testdata/sf0.01").collect()
    assert {r["split"] for r in rows} <= {"train", "val", "test"} and all(r["n"] > 0 and r["trees"] >= 0 for r in rows)


def test_quantiles_and_running_totals(spark):
    rng = np.random.default_rng(5)
    values = [*rng.integers(0, 50, 500).astype(float).tolist(), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(7)
    got = {r["share"]: r["value"] for r in ranked.quantiles(df, "v", [0.0, 0.1, 0.5, 0.98, 1.0]).collect()}
    assert all(abs(v - np.quantile(values[:-1], s)) < 1e-9 for s, v in got.items()) and len(got) == 5
    assert [r["value"] for r in ranked.quantiles(df.where("false"), "v", [0.5]).collect()] == [None]
    run_ = {r["id"]: r["s"] for r in ranked.running(df, [F.col("id")], F.col("v"), "s").collect()}
    want = np.cumsum([v or 0 for v in values])
    assert all(run_[i] == want[i] for i in run_) and len(run_) == len(values)


def test_geojson_kinds(spark, tmp_path):
    """Polygons with holes, multipolygons and other geometries, as collection, feature and bare geometry."""
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    hole = {"type": "Polygon", "coordinates": [square(0, 10), square(4, 6)]}
    many = {"type": "MultiPolygon", "coordinates": [[square(20, 22)], [square(30, 33)]]}
    docs = [{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": hole}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}]}, {"type": "Feature", "geometry": many}, {"type": "Polygon", "coordinates": [square(40, 41)]}]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    edges = geojson.read_polygons(spark, f"file://{tmp_path}")
    assert edges.count() == 4 * 5
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (21.0, 21.0), (31.0, 32.0), (25.0, 25.0), (40.5, 40.5), (None, 1.0)], "lat double, lon double")
    got = [(r["lat"], r["inside"]) for r in geo.in_edges(points, edges).collect()]
    assert sorted(got, key=str) == sorted([(1.0, True), (5.0, False), (21.0, True), (31.0, True), (25.0, False), (40.5, True), (None, False)], key=str)
    one = geo.centroid(edges.where("x1 >= 40")).first()
    assert (round(one["lon"], 6), round(one["lat"], 6)) == (40.5, 40.5)


def test_zipped_csv(spark, tmp_path):
    for k, member in ((1, "AIS_1.CSV"), (2, "deep/AIS_2.csv")):
        with zipfile.ZipFile(tmp_path / f"d{k}.zip", "w") as z:
            z.writestr("readme.txt", "no")
            z.writestr(member, f"MMSI,BaseDateTime,LAT,Name\r\n{k},2024-01-15T00:00:0{k},1.5,\"A, b\"\r\n{k},2024-01-15T00:10:00,,\r\n")
    rows = landing.read_zipped_csv(spark, f"file://{tmp_path}", "MMSI long, BaseDateTime timestamp_ntz, LAT double, Name string")
    got = sorted((r["MMSI"], str(r["BaseDateTime"]), r["LAT"], r["Name"]) for r in rows.where("LAT IS NOT NULL").collect())
    assert got == [(1, "2024-01-15 00:00:01", 1.5, "A, b"), (2, "2024-01-15 00:00:02", 1.5, "A, b")] and rows.count() == 4
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("x.txt", "no")
    with pytest.raises(Exception, match="no .csv"):
        landing.zipped_lines(spark, f"file://{tmp_path}/none.zip").count()


def test_manifest(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    files_ = {"a.bin": b"x" * 3_000_000, "deep/b.bin": b"y"}
    for name, data in files_.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in landing.manifest(spark, f"file://{tmp_path}").collect()}
    assert got == {n.split("/")[-1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files_.items()}


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.yml").write_text("snapshots:\n  one: {bbox: {lon_min: -118.6}}\n  two: {bbox: null}\n")
    cfg = landing.config(f"{tmp_path}/c.yml")
    assert landing.snapshot(cfg, "one")["bbox"]["lon_min"] == -118.6
    with pytest.raises(KeyError, match="one, two"):
        landing.snapshot(cfg, "three")
    monkeypatch.delenv("WAKELINE_TOKEN", raising=False)
    (tmp_path / "t").write_text("PASTE here")
    with pytest.raises(RuntimeError):
        landing.token("WAKELINE_TOKEN", f"{tmp_path}/t")
    (tmp_path / "t").write_text(" abc\n")
    assert landing.token("WAKELINE_TOKEN", f"{tmp_path}/t") == "abc"
    monkeypatch.setenv("WAKELINE_TOKEN", "env")
    assert landing.token("WAKELINE_TOKEN", f"{tmp_path}/t") == "env"


@pytest.fixture
def api():
    """An HTTP report API: one report works at the second try, one never does."""
    seen: list = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            seen.append((url.path, dict(urllib.parse.parse_qsl(url.query)), self.headers.get("Authorization"), self.headers.get("User-Agent")))
            bad = url.path == "/never" or (url.path == "/second" and sum(s[0] == url.path for s in seen) < 2)
            body = b"no" if bad else json.dumps([{"lat": 1.0 + k, "lon": 2.0} for k in range(3)]).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_report_source(spark, api):
    url, seen = api
    spark.dataSource.register(landing.ReportSource)
    df = spark.read.format("vessel_reports").options(url=url, reports="first,second,never", start="2024-01-01", limit="2", token="k", wait="0").load()
    got = {(r["report"], r["n"]) for r in df.groupBy("report").agg(F.count("*").alias("n")).collect()}
    assert got == {("first", 2), ("second", 2)}
    assert sum(s[0] == "/never" for s in seen) == 3 and all(s[2] == "Bearer k" and s[1]["start"] == "2024-01-01" for s in seen)


def test_message_source(spark, tmp_path):
    """A numbered feed that is away at times: each message arrives once, over a restart as well."""
    feed, calls = [{"MessageType": "PositionReport", "MetaData": {"mmsi": k % 3}, "Message": {"Seq": k, "Sec": k}} for k in range(25)], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            url = urllib.parse.urlparse(self.path)
            q = dict(urllib.parse.parse_qsl(url.query))
            bad = len(calls) in (2, 4)
            body = json.dumps(len(feed) if url.path == "/latest" else feed[int(q["from"]) : int(q["to"])]).encode()
            self.send_response(503 if bad else 200)
            self.end_headers()
            self.wfile.write(b"" if bad else body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(landing.MessageSource)
    options = {"url": f"http://127.0.0.1:{server.server_port}", "span": "10", "wait": "0"}
    out, log = f"file://{tmp_path}/out", f"file://{tmp_path}/log"
    stream = lambda: live.parsed(spark.readStream.format("vessel_messages").options(**options).load()).select("seq", "mmsi")
    assert sorted(r["seq"] for r in live.recorded(stream(), out, log, seconds=1).collect()) == list(range(25))
    feed.extend(dict(feed[0], Message={"Seq": k, "Sec": k}) for k in range(25, 31))
    assert sorted(r["seq"] for r in live.recorded(stream(), out, log, seconds=1).collect()) == list(range(31))
    server.shutdown()


def test_download(api, tmp_path):
    url, seen = api
    assert landing.download(f"{url}/first", f"{tmp_path}/f") == (tmp_path / "f").stat().st_size > 0
    assert seen[0][3] == landing.AGENT
    with pytest.raises(OSError):
        landing.download(f"{url}/never", f"{tmp_path}/g")
    assert sorted(x.name for x in tmp_path.iterdir()) == ["f"]


def test_recording_stops_and_restarts(spark, tmp_path):
    """A deadline flushes what came; a restart on the same log reads each file once."""
    src, out, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "log"))
    lines = lambda a, b: spark.range(a, b).selectExpr("cast(id AS string) AS value").coalesce(1).write.mode("append").text(src)
    lines(0, 10)
    stream = lambda: spark.readStream.text(src)
    began = time.monotonic()
    assert live.recorded(stream(), out, log, seconds=1, minutes=0.05).count() == 10
    assert time.monotonic() - began < 60
    lines(10, 15)
    assert sorted(int(r["value"]) for r in live.recorded(stream(), out, log, seconds=1).collect()) == list(range(15))
    assert live.recorded(stream(), out, log, seconds=1).count() == 15


def test_gap_state_over_batches(spark, tmp_path):
    """State lasts over batches; a late ping opens no silence."""
    src = f"file://{tmp_path}/in"
    for rows in ([(1, 0), (1, 100), (2, 0)], [(1, 5000), (1, 50), (2, 1800)]):
        spark.createDataFrame(rows, "mmsi long, sec long").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.01)
    stream = spark.readStream.schema("mmsi long, sec long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    got = sorted(map(tuple, live.landed(live.gaps(stream, 1800), "g").collect()))
    assert got == [(1, 100, 5000)]


def test_whole_run(spark, tmp_path):
    """Bronze to Silver, Gold and dark events of a snapshot, with a manifest of each."""
    (tmp_path / "c.yml").write_text(f"folder: file://{tmp_path}/out\nsnapshots:\n  s1: {{bbox: {{lon_min: -118.5, lat_min: 33.45, lon_max: -117.9, lat_max: 33.95}}}}\n")
    done = run.run(spark, f"{tmp_path}/c.yml", "s1", queries.lens.pings(spark, SF))
    assert set(done) == {"bronze", "silver", "gold", "dark"} and done["bronze"] >= done["silver"] == done["gold"] > 0
    for name, n in done.items():
        assert spark.read.parquet(f"file://{tmp_path}/out/{name}/snapshot=s1").count() == n
        assert spark.read.json(f"file://{tmp_path}/out/manifest/snapshot=s1/{name}").where("length(sha256) = 64").count() > 0


def test_styles(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id long, dark boolean")
    assert [(r["r"], r["label"]) for r in scalar.styled(df).orderBy("id").collect()] == [(255, "dark"), (60, "seen")]
    one = spark.createDataFrame([(3, 5, 10.0), (3, 5, 10.5)], "n_vessels long, n_points long, km double")
    assert tuple(scalar.agreement(one).first()) == (False, 1)


def test_mini_track(spark):
    """One vessel by hand: the first ping, a repeated time, a jump, what follows a dropped ping, a gap."""
    rows = [(0, 33.70), (600, 33.71), (600, 33.72), (1200, 34.00), (1800, 33.73), (9001, 33.80)]
    df = spark.createDataFrame([(i, 1, t, lat, -118.2) for i, (t, lat) in enumerate(rows)], "event_id long, mmsi long, sec long, lat double, lon double")
    seg = track.segments(track.deduplicated(df))
    got = [(r["sec"], r["dt_s"], round(r["dist_km"], 6), r["implied_kn"] and round(r["implied_kn"], 6), r["gap_flag"]) for r in seg.orderBy("sec").collect()]
    assert got == [(0, None, 0.0, None, None), (600, 600, 1.111951, 3.602432, False), (1200, 600, 32.246573, 104.47054, False), (1800, 600, 30.022672, 97.265675, False), (9001, 7201, 7.783656, 2.101127, True)]
    assert [r["sec"] for r in track.without_jumps(seg).orderBy("sec").collect()] == [0, 600, 9001]
    edge = df.where("event_id IN (0, 4)").withColumn("sec", F.when(F.col("sec") == 0, 0).otherwise(1800))
    assert [r["gap_flag"] for r in track.segments(edge).orderBy("sec").collect()] == [None, False]


def test_session_ends_just_at_the_gap(spark, tmp_path):
    """A ping two hours after the last one begins a new session, one a second earlier doesn't; in one batch or in two."""
    rows = [(1, 0), (1, 7199), (1, 14399), (2, 0), (2, 3600)]
    for name, parts in (("one", [rows]), ("two", [rows[:2], rows[2:]])):
        path = f"file://{tmp_path}/{name}"
        for part in parts:
            spark.createDataFrame(part, "mmsi long, sec long").select("mmsi", F.timestamp_seconds("sec").alias("at")).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("mmsi long, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        found = live.completed(live.sessions(stream, "2 hours"), "at-the-gap").select("mmsi", F.unix_timestamp("begin"), "n").collect()
        assert sorted(map(tuple, found)) == [(1, 0, 2), (1, 14399, 1), (2, 0, 2)]
