"""Cells of the sphere, covers and rings by brute force."""

import hashlib
import json
import math
import random
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from oracle_check import differences
from pyspark.sql import functions as F

from wakeline.functions import geo, hexsphere
from wakeline.functions.hexsphere import HexSphere
from wakeline.ml import eta
from wakeline.operators import polygons, sliced, track
from wakeline.plans import places, queries, run
from wakeline.sources import archives, geojson, landing

SF = "/root/testdata/sf0.001"
NAMES = ["sphere_cells", "sphere_traffic", "sphere_parents", "sphere_arrivals", "pings_near_starts", "port_cells", "port_inside", "sliced_segments", "sliced_arrivals", "sliced_last_known", "sliced_sequences", "archive_members"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF) == ""


def one(spark, lat, lon, res):
    return int(hexsphere.cells_of(np.array([lat]), np.array([lon]), res)[0])


def test_published_cells(spark):
    """Ids, a centre and a boundary as published for this grid."""
    known = {(37.3615593, -122.0553238, 5): "85283473fffffff", (37.775938728915946, -122.41795063018799, 9): "8928308280fffff", (40.689167, -74.044444, 10): "8a2a1072b59ffff", (20.0, 123.0, 2): "824b9ffffffffff"}
    assert {k: f"{one(spark, *k):x}" for k in known} == known
    c = spark.createDataFrame([(0x85283473FFFFFFF,)], "c long")
    g = HexSphere(5)
    r = c.select(g.centre(F.col("c")).alias("at"), g.corners(F.col("c")).alias("ring"), g.name(F.col("c")).alias("name")).first()
    assert (round(r["at"]["lat"], 9), round(r["at"]["lon"], 9), r["name"]) == (37.345793375, -121.976375973, "85283473fffffff")
    ring = {(37.271355867, -121.915080327), (37.353926451, -121.862223289), (37.428341186, -121.923549996), (37.420128678, -122.037734964), (37.337556084, -122.090428929), (37.263197975, -122.029101309)}
    assert {(round(p["lat"], 9), round(p["lon"], 9)) for p in r["ring"]} == ring


@pytest.mark.parametrize("res", [0, 2])
def test_whole_sphere(spark, res):
    """All cells are found and lead back to themselves; neighbours agree, twelve cells have five."""
    z = (np.arange(120_000) + 0.5) / 60_000 - 1
    lat, lon = np.degrees(np.arcsin(z)), (np.arange(120_000) * 222.49223594996 + 180) % 360 - 180
    found = sorted(set(hexsphere.cells_of(lat, lon, res)))
    assert len(found) == 2 + 120 * 7**res
    g = HexSphere(res)
    cells = spark.createDataFrame([(int(c),) for c in found], "c long")
    rows = cells.select("c", g.centre(F.col("c")).alias("at"), g.neighbours(F.col("c")).alias("near"), g.sides(F.col("c")).alias("sides"), g.corners(F.col("c")).alias("corners"))
    rows = rows.withColumn("back", g.cell(F.col("at.lat"), F.col("at.lon"))).collect()
    near = {r["c"]: set(r["near"]) for r in rows}
    assert all(r["c"] == r["back"] and {s["neighbour"] for s in r["sides"]} == near[r["c"]] and len(r["corners"]) == len(r["sides"]) == len(near[r["c"]]) for r in rows)
    assert all(c in near[n] for c, ns in near.items() for n in ns)
    assert sorted(map(len, near.values()))[:13] == [5] * 12 + [6]


def test_areas_over_a_national_box(spark):
    """Mean 5.16 km2 at resolution 7, from 0.55 to 1.1 of it over the coasts of a continent; ids don't depend on the region."""
    rng = np.random.default_rng(5)
    lat, lon = rng.uniform(24, 50, 400), rng.uniform(-126, -66, 400)
    ids = hexsphere.cells_of(lat, lon, 7)
    assert [one(spark, a, o, 7) for a, o in zip(lat[:20], lon[:20], strict=True)] == ids[:20].tolist()
    g = HexSphere(7)
    rings = spark.createDataFrame([(int(c),) for c in ids], "c long").select(g.corners(F.col("c")).alias("r")).collect()
    for r in rings:
        lats = [p["lat"] for p in r["r"]]
        k = math.cos(math.radians(sum(lats) / 6)) * 111.195
        xy = [(p["lon"] * k, p["lat"] * 111.195) for p in r["r"]]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, [*xy[1:], xy[0]], strict=True)) / 2
        assert 0.55 * 5.161 < area < 1.5 * 5.161


def test_disks_and_parents(spark):
    g = HexSphere(6)
    cells = spark.createDataFrame([(one(spark, a, o, 6),) for a, o in ((33.7, -118.2), (64.7, 10.5362), (-39.1, 57.7), (0.0, 0.0))], "c long")
    rows = cells.select("c", g.disk(F.col("c"), 2).alias("two"), g.neighbours(F.col("c")).alias("one"), g.centre(F.col("c")).alias("at"), g.parent(F.col("c"), 4).alias("up")).collect()
    for r in rows:
        assert set(r["two"]) == {r["c"], *r["one"], *hexsphere.neighbours_of(np.array(r["one"]), 6).ravel().tolist()} and r["two"][0] == r["c"]
        # the middle child of a cell leads to it
        child = one(spark, r["at"]["lat"], r["at"]["lon"], 7)
        assert (child & ~((15 << 52) | ((1 << 27) - 1))) | (6 << 52) | ((1 << 27) - 1) == r["c"]
        assert (r["up"] ^ r["c"]) >> 33 & (1 << 19) - 1 == 0 and r["up"] & (1 << 33) - 1 == (1 << 33) - 1 and r["up"] >> 52 & 15 == 4
    empty = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "lat double, lon double").select(g.cell(F.col("lat"), F.col("lon")).alias("c"))
    assert [r["c"] for r in empty.collect()] == [None, None] and empty.select(g.centre(F.col("c")).alias("a")).collect()[0]["a"] is None


def star(rng, polygon, x, y, size, n, hole=False):
    """A ring of n corners around a point, and perhaps a hole in its middle."""
    out = []
    for scale, turn in ((1.0, 1), *(((0.3, -1),) if hole else ())):
        r = [size * scale * rng.uniform(0.5, 1.0) for _ in range(n)]
        at = [(x + r[k] * math.cos(2 * math.pi * k / n), y + r[k] * math.sin(2 * math.pi * k / n)) for k in range(n)][::turn]
        out += [(polygon, *p, *q) for p, q in zip(at, [*at[1:], at[0]], strict=True)]
    return out


def test_cover_says_what_parity_says(spark):
    """Stars with holes, overlapping, small ones between cells too; half of all points in one cell."""
    rng = random.Random(6)
    edges = [e for k in range(12) for e in star(rng, f"p{k}", -118 + rng.uniform(-0.3, 0.3), 33.7 + rng.uniform(-0.3, 0.3), rng.choice([0.003, 0.05, 0.2]), rng.choice([3, 7, 40]), k % 2 == 0)]
    points = [(i, 33.7 + rng.uniform(-0.4, 0.4), -118 + rng.uniform(-0.4, 0.4)) for i in range(1500)] + [(i, 33.7 + rng.uniform(-0.005, 0.005), -118 + rng.uniform(-0.005, 0.005)) for i in range(1500, 3000)] + [(3000, None, 1.0)]
    edge_rows = spark.createDataFrame(edges, "polygon string, x1 double, y1 double, x2 double, y2 double")
    rows = spark.createDataFrame(points, "id long, lat double, lon double")
    hits = polygons.within(rows, polygons.cover(edge_rows, 7), 7)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = set()
    for i, lat, lon in points[:-1]:
        for p in {e[0] for e in edges}:
            n = sum((y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 for q, x1, y1, x2, y2 in edges if q == p)
            if n % 2:
                want.add((i, p))
    got = [(r["id"], r["polygon"]) for r in hits.collect()]
    assert set(got) == want and len(got) == len(want) > 500
    assert polygons.within(rows, polygons.cover(edge_rows.where("false"), 7), 7).count() == 0


def test_rings_with_holes_and_islands(spark, tmp_path):
    """A wide ring of cells around a hole with an island in it, and a far cell: areas are the cells', GeoJSON gives the same set."""
    g = HexSphere(8)
    centre = one(spark, 33.75, -118.2, 8)
    disks = spark.createDataFrame([(centre,)], "c long").select(g.disk(F.col("c"), 4).alias("four"), g.disk(F.col("c"), 2).alias("two")).first()
    far = one(spark, 33.9, -118.0, 8)
    kept = sorted({*disks["four"]} - {*disks["two"]} | {centre, far})
    cells = spark.createDataFrame([(c,) for c in kept], "cell long")
    rings = polygons.rings(polygons.outline(cells, g))
    found = rings.collect()
    by = {r["ring"]: r for r in found}
    assert len(found) == 4 and sorted(r["area"] > 0 for r in found) == [False, True, True, True]
    hole = next(r for r in found if r["area"] < 0)
    assert hole["outer"] != hole["ring"] and by[hole["outer"]]["area"] == max(r["area"] for r in found) and len(hole["points"]) == 31
    assert all(r["points"][0] == r["points"][-1] for r in found) and sorted(len(r["points"]) - 1 for r in found) == [6, 6, 30, 54]
    corners = cells.select(g.corners(F.col("cell")).alias("r")).collect()
    area = sum(a["lon"] * b["lat"] - b["lon"] * a["lat"] for r in corners for a, b in zip(r["r"], [*r["r"][1:], r["r"][0]], strict=True)) / 2
    assert abs(sum(r["area"] for r in found) - area) < 1e-12
    geojson.write_rings(rings, f"{tmp_path}/rings")
    texts = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/rings").collect()]
    assert sorted(len(t["features"][0]["geometry"]["coordinates"]) for t in texts) == [1, 1, 2]
    edges = geojson.read_polygons(spark, f"{tmp_path}/rings")
    rng = random.Random(9)
    points = spark.createDataFrame([(33.75 + rng.uniform(-0.05, 0.05), -118.2 + rng.uniform(-0.05, 0.05)) for _ in range(3000)], "lat double, lon double")
    rows = geo.in_edges(points, edges).withColumn("cell", g.cell(F.col("lat"), F.col("lon"))).collect()
    assert all(r["inside"] == (r["cell"] in kept) for r in rows) and 0 < sum(r["inside"] for r in rows) < 3000
    assert polygons.rings(polygons.outline(cells.where("false"), g)).count() == 0


def test_box_as_a_closed_ring():
    assert geo.closed_ring((1.0, 2.0, 3.0, 4.0)) == [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 4.0), (1.0, 2.0)]
    assert places.RES == 7


@pytest.mark.parametrize("rows", [3, 40, 10_000])
def test_slices_change_nothing(spark, rows):
    """Small slices, gaps of many buckets, repeated times; a vessel of half of all pings is in many slices of about `rows` pings."""
    rng = random.Random(rows)
    pings = [(i, 100 if i % 2 else 100 + rng.randrange(5), rng.choice([rng.randrange(4000), rng.randrange(4_000_000)]), rng.uniform(33, 34), rng.uniform(-119, -118), rng.random() < 0.2, rng.choice([None, i])) for i in range(1200)]
    df = spark.createDataFrame(pings, "event_id long, mmsi long, sec long, lat double, lon double, inside boolean, v long").repartition(7)
    cut = sliced.sliced(df, rows, 60)
    held = cut.where("mmsi = 100").groupBy("slice").count().collect()
    assert len(held) == 1 if rows > 1200 else len(held) >= 0.5 * 600 / (rows + 20)
    same = lambda a, b, *c: sorted(map(str, a.select("event_id", *c).collect())) == sorted(map(str, b.select("event_id", *c).collect()))
    assert same(sliced.deduplicated(cut), track.deduplicated(df))
    assert same(sliced.segments(cut), track.segments(df), "dt_s", "dist_km", "implied_kn", "gap_flag")
    entered = sliced.entries(cut)
    assert same(entered, track.entries(df), "entry")
    assert same(sliced.next_arrival(entered), track.next_arrival(track.entries(df)), "arrival")
    assert same(sliced.last_known(cut, F.col("v"), "last"), track.last_known(df, F.col("v"), "last"), "last")
    labelled = lambda x: x.withColumn("has_eta", F.col("event_id") % 3 == 0)
    assert same(sliced.sequences(labelled(cut), ["sec", "lat"]), track.sequences(labelled(df), ["sec", "lat"]), "steps")


def test_archives_by_member(spark, tmp_path):
    """A partition for each member, chosen by pattern; damaged and empty archives fail, an empty folder has no rows."""
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("notes.txt", "x\n")
        z.writestr("One.CSV", "id,name\r\n1,é\r\n\r\n2,\r\n")
        with z.open("two.csv", "w") as f:
            f.write(b"id,name\n")
            for k in range(300_000):
                f.write(b"%d,%s\n" % (k, b"v" * 40))
    (tmp_path / "none").mkdir()
    spark.dataSource.register(archives.ArchiveSource)
    of = lambda path, **o: spark.read.format("vessel_archives").options(path=f"file://{path}", **o).load()
    first = of(tmp_path).orderBy("n").collect()
    assert [(r["member"], r["n"], r["line"]) for r in first] == [("One.CSV", 0, "id,name"), ("One.CSV", 1, "1,é"), ("One.CSV", 2, ""), ("One.CSV", 3, "2,")]
    every = of(tmp_path, all="true")
    assert every.rdd.getNumPartitions() == 2 and every.count() == 300_005
    assert [tuple(r) for r in archives.read_csv(spark, f"file://{tmp_path}/a.zip", "id long, name string").orderBy("id").collect()] == [(1, "é"), (2, None)]
    assert archives.read_csv(spark, f"file://{tmp_path}", "id long, name string", member="two*").agg(F.sum("id")).first()[0] == 300_000 * 299_999 // 2
    assert of(tmp_path / "none").count() == 0
    for bad in (f"{tmp_path}/missing", f"{tmp_path}/broken.zip", f"{tmp_path}/other.zip"):
        if bad.endswith("broken.zip"):
            (tmp_path / "broken.zip").write_bytes(b"PK no archive")
        if bad.endswith("other.zip"):
            with zipfile.ZipFile(bad, "w") as z:
                z.writestr("readme", "x")
        with pytest.raises(Exception, match="No such|NotFound|missing|not a zip|no \\*.csv"):
            of(bad).count()


def test_hashes_of_large_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    blobs = {f"f {k}.bin": bytes([k]) * size for k, size in enumerate((1, 1000, 3_000_000, 1 << 20))}
    for name, raw in blobs.items():
        (tmp_path / "in" / name).write_bytes(raw)
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in landing.manifest(spark, f"file://{tmp_path}/in", 1000).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in blobs.items()}


def test_run_from_archives_to_model(spark, tmp_path):
    """Zipped daily files to Bronze, Silver, Gold, dark events, sequences and a trained model, by the command line's flags."""
    p = queries.lens.pings(spark, SF)
    mmsi, sec = 200000000 + F.col("event_id") % 9, F.col("event_id") * 120
    rows = p.select(mmsi.alias("MMSI"), F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss").alias("BaseDateTime"), (33.75 + F.sin(F.col("event_id") / 40.0) * 0.06).alias("LAT"), F.lit(-118.2).alias("LON"), F.lit(8.0).alias("SOG"), F.col("cog").alias("COG"), F.lit(511.0).alias("Heading"), *(F.lit(None).cast("string").alias(c) for c in "VesselName IMO CallSign VesselType Status Length Width Draft Cargo TransceiverClass".split()))
    folder = f"file://{tmp_path}"
    archives.write_csv(rows.repartition(3), f"{folder}/zips").collect()
    (tmp_path / "c.yml").write_text(f"folder: {folder}/out\nsnapshots:\n  s1: {{archives: '{folder}/zips', bbox: {{lon_min: -118.5, lat_min: 33.45, lon_max: -117.9, lat_max: 33.95}}}}\n")
    flags = ["--config", f"{tmp_path}/c.yml", "--snapshot", "s1"]
    done = run.main([*flags, "--res", "8", "--horizon-min", "600"])
    assert done["bronze"] == p.count() and done["gold"] == done["silver"] > 0 and done["sequences"] > 0 and done["report"] > 0
    gold = spark.read.parquet(f"{folder}/out/gold/snapshot=s1")
    assert gold.where("cell LIKE '88%fffff' AND length(cell) = 15").count() == done["gold"] and gold.agg(F.max(F.when(F.col("has_eta"), F.col("eta_min")))).first()[0] <= 600
    split = gold.join(spark.read.parquet(f"{folder}/out/sequences/snapshot=s1").select("event_id", "y"), "event_id")
    assert split.where("abs(y - ln(1 + eta_min)) > 1e-9").count() == 0
    assert eta.load(f"{folder}/out/model/snapshot=s1").getNumTrees == 20
    again = run.main([*flags, "--skip-ingest", "--no-model"])
    assert set(again) == {"silver", "gold", "dark"} and again["silver"] == done["silver"]


def test_mean_speed_of_cells_is_that_of_the_decimals(spark):
    """The mean of speeds as they are written, whatever the order in which they are added up."""
    sf, speeds = "/root/testdata/sf0.01", {}
    for r in places._pings(spark, sf).select(HexSphere.name(F.col("sid")).alias("cell"), "sog").where("sog > 0.5").collect():
        speeds.setdefault(r["cell"], []).append(Decimal(repr(round(r["sog"], 12))))
    want = {c: math.floor(float(sum(v)) / len(v) * 10000 + 0.5) / 10000 for c, v in speeds.items()}
    assert {r["cell"]: r["mean_sog"] for r in places.sphere_traffic(spark, sf).where("mean_sog IS NOT NULL").collect()} == want


def test_repeated_positions_are_paired_once(spark, tmp_path, monkeypatch):
    """Copies of all pings at the same places, by other vessels, make no more pairs with boxes; each vessel has the counts of all."""
    events = spark.read.parquet(f"{SF}/events.parquet").limit(60).cache()
    copies = [events.withColumns({"event_id": F.col("event_id") + k * 1009 * 997, "user_id": F.col("user_id") + k * 100_000}) for k in range(3)]
    copies[0].union(copies[1]).union(copies[2]).write.parquet(f"{tmp_path}/events.parquet")
    events.write.parquet(f"{tmp_path}/one/events.parquet")
    pairs, within = [], polygons.within
    monkeypatch.setattr(polygons, "within", lambda *a: pairs.append(within(*a)) or pairs[-1])
    one, three = ({r["polygon"]: r["n"] for r in places.pings_near_starts(spark, str(d)).collect()} for d in (tmp_path / "one", tmp_path))
    assert three == {m + k * 100_000: 3 * n for m, n in one.items() for k in range(3)}
    assert pairs[0].count() == pairs[1].count()
