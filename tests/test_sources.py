"""Readers on small files, sinks and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terralith.operators import networks as net
from terralith.operators import places, terrain
from terralith.sources import readers, sinks
from terralith.streaming.increments import process_new_patches

OSM = """<?xml version="1.0"?><osm>
<node id="1" lat="45.1" lon="15.0"/><node id="2" lat="45.1" lon="15.1"><tag k="man_made" v="chimney"/><tag k="height" v="1"/><tag k="height" v="80"/></node>
<way id="7"><nd ref="1"/><nd ref="2"/><tag k="building" v="yes"/></way>
<relation id="9"><member type="way" ref="7" role="outer"/><member type="way" ref="8" role=""/><tag k="type" v="multipolygon"/></relation></osm>"""


def test_map_extract(spark, tmp_path):
    (tmp_path / "map_036019.osm").write_text(OSM)
    nodes, ways, relations = readers.read_map_elements(spark, f"{tmp_path}/*.osm")
    assert sorted((r.patch_id, r.node_id, r.tags.get("height")) for r in nodes.collect()) == [("036019", "1", None), ("036019", "2", "80")]
    assert ways.first().refs == ["1", "2"] and ways.first().tags == {"building": "yes"}
    assert [(m.ref, m.role) for m in relations.first().members] == [("7", "outer"), ("8", "")]
    patches = spark.createDataFrame([("036019", 45.0, 45.2, 14.9, 15.2)], "patch_id string, lat_min double, lat_max double, lon_min double, lon_max double")
    known = spark.createDataFrame([("5",)], "node_id string")
    assert [r.node_id for r in readers.read_side_points(spark, f"{tmp_path}/*.osm", known, patches).collect()] == ["2"]


def test_patch_metadata(spark, tmp_path):
    (tmp_path / "h036019.txt").write_text("ZoneNumber: 33\ntranslate_x: -500000\nTranslateY: -5000000\nlat_min: 45.0\nlatMax: 45.1\nlon_min: 15\n")
    r = readers.read_patch_metadata(spark, f"{tmp_path}/h*.txt").first()
    assert (r.patch_id, r.zone_number, r.translate_x, r.lat_max, r.errors) == ("036019", 33, -500000.0, 45.1, ["lon_max"])


def test_terrain(spark, tmp_path):
    (tmp_path / "h000001.obj").write_text("v 0 0 1\nv 30 0 1\nv 30 30 2\nv 0 30 2\nf 1/1/1 2 3 4\nf 1 2 3\n")
    t = readers.read_terrain(spark, f"{tmp_path}/*.obj")
    assert sorted(r.tri for r in t.collect()) == [0, 1, 2]
    points = spark.createDataFrame([("000001", "a", 15.0, 7.5), ("000001", "b", 99.0, 0.0)], "patch_id string, id string, px double, py double")
    assert [(r.id, round(r.z, 6)) for r in terrain.elevations(points, t, ["id"]).collect()] == [("a", 1.25)]


def test_tilted_plane_gives_the_lowest_sample(spark):
    corner = lambda x, y: (x, y, 0.01 * x + 100)
    a, b, c, d = corner(-60.0, -60.0), corner(60.0, -60.0), corner(60.0, 60.0), corner(-60.0, 60.0)
    names = ", ".join(f"{n}{k} double" for k in (1, 2, 3) for n in "xyz")
    tri = spark.createDataFrame([("0", 0, *a, *b, *c), ("0", 1, *a, *c, *d)], f"patch_id string, tri int, {names}")
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    house = spark.createDataFrame([("0", "h", ring, []), ("1", "h", ring, [])], "patch_id string, osm_id string, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    got = {r.patch_id: r.floor_z for r in terrain.floors(house, tri).collect()}
    low = min(r.px for r in terrain.sample_grid(house).collect())
    assert got["0"] == pytest.approx(0.01 * low + 100 - 0.3) and got["1"] == 0.0


def test_footprints_tiles_airports(spark, tmp_path):
    ring = [[15.0, 45.0], [15.1, 45.0], [15.1, 45.1], [15.0, 45.0]]
    lines = [{"geometry": {"type": "Polygon", "coordinates": [ring]}}, {"geometry": {"type": "Point", "coordinates": None}}, {"geometry": {"type": "Polygon", "coordinates": [ring[:2]]}}]
    (tmp_path / "ml.json").write_text("\n".join(json.dumps(x) for x in lines))
    r = readers.read_ml_footprints(spark, f"{tmp_path}/ml.json").collect()
    assert len(r) == 1 and len(r[0].ring) == 3 and r[0].lat == pytest.approx(45.0333333)
    (tmp_path / "t.csv").write_text("Location,QuadKey,Url\nx,120,b\nx,120,a\ny,121,c\n")
    assert {(x.quadkey, tuple(x.urls)) for x in readers.read_tile_index(spark, f"{tmp_path}/t.csv").collect()} == {("120", ("a", "b")), ("121", ("c",))}
    (tmp_path / "a.json").write_text(json.dumps({"X": {"length": 1000, "center": [45.0, 15.0], "source": "runway"}}))
    a = readers.read_airports(spark, f"{tmp_path}/a.json").first()
    assert (a.name, a.zone_m, a.lat) == ("X", 958.0, 45.0)


def test_resolve_inputs_and_grid(spark):
    patches = readers.patch_grid(spark, 1, 2, 5, 5)
    assert [r.patch_id for r in patches.orderBy("patch_id").collect()] == ["001005", "002005"]
    files = spark.createDataFrame([("001005", "map", "any", 3), ("001005", "map", "own", 0), ("001005", "terrain", "base", 1)], "patch_id string, kind string, path string, priority int")
    got = {(r.patch_id, r.kind): r.path for r in readers.resolve_inputs(patches, files).collect()}
    assert got[("001005", "map")] == "own" and got[("002005", "map")] is None and len(got) == 6


def test_sinks_replace_only_their_patches(spark, tmp_path):
    rows = lambda p: spark.createDataFrame([(p, 0, "houses", [(0.0, 0.0, 0.0)] * 3), (p, 0, "houses", [(0.0, 0.0, 0.0)] * 2)], "patch_id string, lod int, grp string, corners array<struct<x:double,y:double,z:double>>")
    for p in ("1", "2", "1"):
        sinks.write_faces(rows(p), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 2
    sinks.write_report(spark.createDataFrame([("1", 5)], "patch_id string, n int"), f"{tmp_path}/r")
    for _ in range(2):
        sinks.append_run_log(spark.createDataFrame([("1", 5)], "patch_id string, n int"), f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/r").first().n == 5 and spark.read.parquet(f"{tmp_path}/l").count() == 2


def test_stream_replaces_patches(spark, tmp_path):
    put = lambda p, n: spark.createDataFrame([(p, n)], "patch_id string, n int").write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: process_new_patches(spark, f"{tmp_path}/in", "patch_id string, n int", lambda d: d.withColumn("n", F.col("n") + 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    put("a", 1)
    put("b", 2)
    run()
    put("a", 7)
    run()
    assert sorted((r.patch_id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 8), ("b", 3)]


def test_line_in_out_in_out(spark):
    rows = [("p", "w", i, float(x), 0.0, inside, True) for i, (x, inside) in enumerate([(0, True), (10, True), (5000, False), (5010, False), (20, True), (6000, False)])]
    points = spark.createDataFrame(rows, "patch_id string, way_id string, pos int, x double, y double, in_patch boolean, is_support boolean")
    r = net.line_statistics(points).first()
    assert (r.transitions, r.runs, r.status) == (3, 2, "crossing")
    assert [x.placed for x in net.placed(points).orderBy("pos").collect()] == [True] * 6


def test_spacing_is_constant(spark):
    rows = [("p", "w", i, float(x), 0.0, True, True) for i, x in enumerate([0, 7, 7, 31, 90])]
    points = spark.createDataFrame(rows, "patch_id string, way_id string, pos int, x double, y double, in_patch boolean, is_support boolean")
    xs = sorted(r.x for r in net.equally_spaced(points, 15.0).collect())
    assert xs == pytest.approx([0, 15, 30, 45, 60, 75])


def test_better_sources_win(spark):
    schema = "name string, source string, length_m double"
    old = spark.createDataFrame([("A", "runway", 1000.0), ("B", "aerodrome", 1500.0)], schema)
    new = spark.createDataFrame([("A", "runway", 2000.0), ("B", "runway_disused", 900.0), ("C", "aerodrome", 1.0)], schema)
    got = {r.name: (r.source, r.length_m) for r in places.upsert_airports(old, new).collect()}
    assert got == {"A": ("runway", 1000.0), "B": ("runway_disused", 900.0), "C": ("aerodrome", 1.0)}


def test_chimney_way_round_a_chimney_node_goes(spark):
    ring = lambda x: [(x, 0.0), (x + 4, 0.0), (x + 4, 4.0), (x, 4.0)]
    ways = spark.createDataFrame([("p", "1", 1, ring(0.0)), ("p", "2", 2, ring(10.0)), ("p", "3", 3, ring(11.0))], "patch_id string, way_id string, nth int, ring array<struct<x:double,y:double>>")
    nodes = spark.createDataFrame([("p", 1.0, 1.0)], "patch_id string, x double, y double")
    assert [r.way_id for r in places.quiet_ways(ways, nodes).collect()] == ["2"]


def _ring(x, y, half):
    return [{"x": float(x + u), "y": float(y + v)} for u, v in ((-half, -half), (half, -half), (half, half), (-half, half))]


WAYS = "patch_id string, way_id string, nth long, ring array<struct<x: double, y: double>>"


def test_suppressed_ways_suppress_nothing(spark):
    """A's centre lies in B, B's in C, A's not in C: A and C stay. So does D, around C's centre only if C were gone."""
    ways = [("p", "A", 1, _ring(0, 0, 1)), ("p", "B", 2, _ring(3, 0, 4)), ("p", "C", 3, _ring(6, 0, 4)), ("p", "D", 4, _ring(6, 0, 1)), ("q", "A", 1, _ring(0, 0, 1))]
    nodes = spark.createDataFrame([("r", 0.0, 0.0)], "patch_id string, x double, y double")
    found = places.quiet_ways(spark.createDataFrame(ways, WAYS), nodes)
    assert sorted((r.patch_id, r.way_id) for r in found.collect()) == [("p", "A"), ("p", "C"), ("q", "A")]
    assert found.columns == ["patch_id", "way_id", "nth", "ring"]
    assert places.quiet_ways(spark.createDataFrame([], WAYS), nodes).count() == 0


def test_quiet_ways_equal_a_pass_in_order(spark):
    """Ten thousand dense ways, with long chains among them, against a loop."""
    rng = random.Random(8)
    ways = [("p", str(k), k, _ring(rng.uniform(0, 2000), rng.uniform(0, 2000), rng.uniform(2, 40))) for k in range(9960)]
    ways += [("p", f"c{k}", 20000 + k, _ring(5000 + 3 * k, 0, 4)) for k in range(40)]
    nodes = [("p", rng.uniform(0, 2000), rng.uniform(0, 2000)) for _ in range(200)]
    taken, cells = [], {}
    listed = lambda x, y: cells.setdefault((x // 50, y // 50), [])
    for _, x, y in nodes:
        listed(x, y).append((x, y))
    for _, name, _, ring in ways:
        x0, y0, x1, y1 = [f(p[a] for p in ring) for f in (min, max) for a in "xy"]
        near = (p for gx in range(int(x0 // 50), int(x1 // 50) + 1) for gy in range(int(y0 // 50), int(y1 // 50) + 1) for p in cells.get((gx, gy), []))
        if not any(x0 < x < x1 and y0 < y < y1 for x, y in near):
            taken.append(name)
            mid = [(ring[0][a] + sum(p[a] for p in ring)) / 5 for a in "xy"]
            listed(*mid).append(tuple(mid))
    found = places.quiet_ways(spark.createDataFrame(ways, WAYS).repartition(4), spark.createDataFrame(nodes, "patch_id string, x double, y double"))
    assert sorted(r.way_id for r in found.collect()) == sorted(taken) and 100 < len(taken) < 9000


def _rows_joined(df):
    """The most rows that a join of the executed plan gave."""
    df.collect()
    found, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            open_.append(node.plan())
            continue
        if "Join" in name:
            found = max(found, node.metrics().apply("numOutputRows").value())
        children = node.children()
        open_ += [children.apply(k) for k in range(children.size())]
    return found


def test_many_runways_and_aerodromes_at_one_place(spark):
    """300 runways and 200 aerodromes at each of two places meet as places, and the first name of equal boxes wins."""
    runways = spark.range(600).selectExpr("id AS runway_id", "45.0 + id % 2 AS lat", "15.0D AS lon", "CAST(NULL AS string) AS ref").withColumn("lat", F.col("lat").cast("double"))
    aerodromes = spark.range(400).selectExpr("concat('n', lpad(id, 3, '0')) AS name", "CAST(45.0 + id % 2 AS double) AS c_lat", "15.0D AS c_lon").selectExpr("*", "c_lat - 0.01D AS lat_min", "c_lat + 0.01D AS lat_max", "14.9D AS lon_min", "15.1D AS lon_max")
    found = places.runway_names(runways, aerodromes)
    assert {(r.runway_id % 2, r.name) for r in found.collect()} == {(0, "n000"), (1, "n001")} and found.count() == 600
    assert _rows_joined(found) <= 600


def test_many_airports_and_patches_at_one_place(spark, monkeypatch):
    """50 airports at one place and 50 equal patches around it are projected once, and each pair comes out."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("struct<x: double, y: double>")
    def projected(lat, lon, zone, tx, ty):
        calls.add(1)
        return 1.0, 2.0

    monkeypatch.setattr(places.geo, "project_utm", projected)
    airports = spark.range(50).selectExpr("id", "45.05D AS lat", "15.05D AS lon")
    patches = spark.range(50).selectExpr("CAST(id AS string) AS patch_id", "33 AS zone", "0.0D AS tx", "0.0D AS ty", "45.02D AS lat_min", "45.08D AS lat_max", "15.01D AS lon_min", "15.09D AS lon_max")
    found = places.airports_in_patches(airports, patches).collect()
    assert len({(r.patch_id, r.id) for r in found}) == len(found) == 2500 and calls.value <= 2


def test_many_ways_over_each_other_give_few_pairs(spark, monkeypatch):
    """600 ways of many sizes at 6 places: all that a pass in order accepts, from far fewer than all pairs."""
    ways = []
    for k in range(600):
        x, y, a = (k % 6) * 70.0, (k * 7 % 3) * 10.0, 3.0 + k * 37 % 60
        ways.append(("000001", f"w{k}", k, [{"x": x - a, "y": y - a}, {"x": x + a, "y": y - a}, {"x": x + a, "y": y + a}, {"x": x - a, "y": y + a}]))
    pairs, first_fit = [], places.first_fit
    monkeypatch.setattr(places, "first_fit", lambda met: pairs.append(met.count()) or first_fit(met))
    df = spark.createDataFrame(ways, "patch_id string, way_id string, nth long, ring array<struct<x: double, y: double>>")
    nodes = spark.createDataFrame([], "patch_id string, x double, y double")
    got = {r.way_id for r in places.quiet_ways(df, nodes, 50.0, 20).collect()}
    want, centres = set(), []
    for _, way, _, ring in ways:
        # The mean of a closed ring has its first corner twice.
        c = tuple((sum(p[axis] for p in ring) + ring[0][axis]) / 5 for axis in "xy")
        if not any(ring[0]["x"] < x < ring[2]["x"] and ring[0]["y"] < y < ring[2]["y"] for x, y in centres):
            want.add(way)
            centres.append(c)
    assert got == want and sum(pairs) < 3000
