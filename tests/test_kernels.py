"""Arrow kernels against plain versions, with null, empty and degenerate lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terralith.functions import kernels, rings
from terralith.operators import footprints as fo
from terralith.operators import networks as net
from terralith.operators import panels as pa
from terralith.operators import places, terrain

RINGS = "id int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


def some_rings():
    rng = random.Random(4)
    out = []
    for i in range(60):
        n = rng.randint(3, 9)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        out.append((i, [(rng.uniform(2, 9) * math.cos(t) + 50, rng.uniform(2, 9) * math.sin(t)) for t in turns], [[(49.0, 0.0), (49.0, 1.0), (50.0, 1.0)]] if i % 3 == 0 else []))
    return [*out, (97, [], []), (98, [(1.0, 1.0)], []), (99, None, [])]


def test_ring_measures_equal_the_column_expressions(spark):
    frame = spark.createDataFrame(some_rings(), RINGS).repartition(3)
    got = fo.computed(frame.where("size(outer) > 2").select("*", kernels.ring_measures("outer", "holes").alias("m")), {"angle": rings.longest_edge_angle(F.col("outer"))})
    plain = got.select(
        "m", "angle", rings.area(F.col("outer"), F.col("holes")).alias("area"), rings.perimeter(F.col("outer")).alias("perimeter"), rings.is_convex(F.col("outer")).alias("convex"),
        rings.is_rectangle_like(F.col("outer")).alias("rectangle"), rings.vertex_mean(F.col("outer")).alias("mean"), rings.bbox(F.col("outer")).alias("bbox"), rings.oriented_box(F.col("outer"), F.col("angle")).alias("obb"),
    )
    rows = plain.collect()
    assert len(rows) == 60 and {r.m.convex for r in rows} == {True, False}
    for r in rows:
        assert (r.m.area, r.m.perimeter, r.m.axis_deg) == pytest.approx((r.area, r.perimeter, r.angle)) and (r.m.convex, r.m.rectangle_like) == (r.convex, r.rectangle)
        assert tuple(r.m.centroid) == pytest.approx(tuple(r.mean)) and tuple(r.m.bbox) == pytest.approx(tuple(r.bbox)) and tuple(r.m.obb) == pytest.approx(tuple(r.obb))


def test_empty_and_null_rings(spark):
    frame = spark.createDataFrame(some_rings()[-3:], RINGS)
    got = {r.id: r for r in frame.select("id", kernels.ring_measures("outer", "holes").alias("m"), kernels.hull_area("outer").alias("hull"), kernels.inside_samples("outer", "holes", F.lit(5.0)).alias("s")).collect()}
    assert got[99].m is None and got[99].hull is None and got[97].m.vertices == 0 and got[98].m.area == 0.0 and got[97].s == []


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise, by a plain loop."""
    def chain(ordered):
        out: list[tuple[float, float]] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ordered = sorted(set(points))
    return ordered if len(ordered) < 3 else chain(ordered) + chain(ordered[::-1])


def test_hulls_of_many_rings(spark):
    """Random concave rings, with points in a row, on one spot and in a line, against the plain hull."""
    rng = random.Random(9)
    rows = []
    for k in range(400):
        n = rng.choice([3, 4, 5, 8, 20, 60])
        x0, y0, grid = rng.uniform(-2880, 2880), rng.uniform(-2880, 2880), rng.random() < 0.4
        points = []
        for i in range(n):  # a star around a centre: concave, and simple
            r, turn = rng.uniform(1, 30), 2 * math.pi * (i + rng.random() * 0.5) / n
            x, y = x0 + r * math.cos(turn), y0 + r * math.sin(turn)
            points.append((float(round(x)), float(round(y))) if grid else (x, y))
        rows.append((k, points, []))
    rows += [(400, [(1.0, 1.0)] * 5, []), (401, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (1.0, 1.0)], []), (402, [], [])]
    got = {r.id: r.a for r in spark.createDataFrame(rows, RINGS).coalesce(1).select("id", kernels.hull_area("outer").alias("a")).collect()}
    for k, points, _ in rows:
        edge = hull(points)
        x0, y0 = points[0] if points else (0.0, 0.0)
        want = abs(sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(edge, edge[1:] + edge[:1]))) / 2
        assert got[k] == pytest.approx(want, abs=1e-7), k


def test_hull_of_an_ell_and_of_any_ring(spark):
    ell = (0, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)], [])
    rows = fo.convexity(spark.createDataFrame([ell, *some_rings()[:60]], RINGS)).collect()
    assert {r.id: r for r in rows if r.hull_area == 14.0}[0].convexity_ratio == pytest.approx(12 / 14)
    for r in rows[1:]:
        points = [(p.x, p.y) for p in r.outer]
        edge = hull(points)
        assert set(edge) <= set(points) and all(any(abs(p[0] - q[0]) + abs(p[1] - q[1]) < 1e-12 for q in edge) or _within(edge, p) for p in points)


def _within(edge, p):
    return all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-9 for a, b in zip(edge, edge[1:] + edge[:1]))


def test_samples_lie_inside(spark):
    frame = spark.createDataFrame(some_rings()[:60], RINGS)
    rows = frame.select("outer", "holes", F.explode(kernels.inside_samples("outer", "holes", F.lit(1.5))).alias("p"))
    inside = rings.inside_even_odd(F.col("outer"), F.col("p.px"), F.col("p.py")) & ~F.exists("holes", lambda h: rings.inside_even_odd(h, F.col("p.px"), F.col("p.py")))
    assert rows.where(~inside).count() == 0 and rows.count() > 1000


def quad_roof(spark, ring, overhang=0.5):
    frame = spark.createDataFrame([(1, ring, [])], RINGS)
    return frame.select(kernels.hipped_faces(F.col("outer"), F.lit(6.0), F.lit(overhang), F.lit(0.25), F.lit(0.75)).alias("r")).first().r


def test_hips_of_a_rectangle(spark):
    roof = quad_roof(spark, [(0.0, 0.0), (20.0, 0.0), (20.0, 8.0), (0.0, 8.0)], 0.0)
    assert not roof.pyramid and [len(f) for f in roof.faces] == [3, 4, 3, 4]
    tops = {(round(p.x, 6), round(p.y, 6), round(p.z, 6)) for f in roof.faces for p in f if p.z > 6}
    assert tops == {(4.0, 4.0, 7.2), (16.0, 4.0, 7.2)}  # 3 m rise over half the length, 4 m from each edge
    assert [round(p.u, 6) for p in roof.faces[0]] == [0.0, 2.0, 1.0] and {p.v for p in roof.faces[1]} == {0.25, 0.75}
    wide = quad_roof(spark, [(0.0, 0.0), (20.0, 0.0), (20.0, 8.0), (0.0, 8.0)])
    assert min(p.x for f in wide.faces for p in f) == pytest.approx(-0.5) and min(p.z for f in wide.faces for p in f) == pytest.approx(6 - 0.3 * 0.5)


def test_square_is_a_pyramid_and_five_corners_have_no_hip(spark):
    roof = quad_roof(spark, [(0.0, 0.0), (10.0, 0.0), (10.0, 9.0), (0.0, 9.0)])
    assert roof.pyramid and {len(f) for f in roof.faces} == {3} and max(p.z for f in roof.faces for p in f) == 9.0
    assert quad_roof(spark, [(0.0, 0.0), (10.0, 0.0), (10.0, 9.0), (5.0, 12.0), (0.0, 9.0)]).faces == []


def test_normals_and_sums_of_faces(spark):
    corners = "id int, corners array<struct<x:double,y:double,z:double,u:double,v:double>>"
    frame = spark.createDataFrame([(1, [(0.0, 0.0, 0.0, 0.0, 1.0), (2.0, 0.0, 0.0, 1.0, 1.0), (2.0, 3.0, 0.0, 1.0, 2.0), (0.0, 3.0, 0.0, 0.0, 2.0)]), (2, [])], corners)
    got = {r.id: r for r in frame.select("id", kernels.face_normal("corners").alias("n"), kernels.corner_sums("corners").alias("s")).collect()}
    assert tuple(got[1].n) == (0.0, 0.0, 12.0) and (got[1].s.area, got[1].s.x, got[1].s.u) == (6.0, 4.0, 2.0) and got[2].s.area == 0.0


def test_merging_rebases_indices(spark):
    group = "patch_id string, lod int, grp string"
    vertices = spark.createDataFrame([("p", 0, g, i) for g, n in (("houses", 3), ("hipped_roofs", 2), ("walls", 1)) for i in range(1, n + 1)], group + ", vertex_id int")
    corners = spark.createDataFrame([("p", 0, "hipped_roofs", "b", 0, 0, 0, k, k + 1) for k in range(2)], group + ", osm_id string, ring_no int, pos int, part int, corner int, vertex_id int")
    into = F.when(F.col("grp") == "hipped_roofs", "houses").otherwise(F.col("grp"))
    v, c = pa.numbered_for_export(*pa.merged_groups(vertices, corners, into, F.when(F.col("grp") == "hipped_roofs", 1).otherwise(0)))
    assert sorted((r.grp, r.was, r["index"]) for r in v.collect()) == [("houses", "hipped_roofs", 4), ("houses", "hipped_roofs", 5), ("houses", "houses", 1), ("houses", "houses", 2), ("houses", "houses", 3), ("walls", "walls", 6)]
    assert sorted((r["index"], r.uv_index) for r in c.collect()) == [(4, 1), (5, 2)]


def test_carriers_run_on_from_the_first_cable_to_the_second(spark):
    rows = [("p", "w", i, x, 0.0, True, "Pylon_AerialCab", 0.0) for i, x in enumerate([0.0, 100.0, 200.0])]
    points = spark.createDataFrame(rows, "patch_id string, way_id string, pos int, x double, y double, in_patch boolean, pylon string, foot_z double")
    got = sorted((r.item, r.leg, round(r.x, 6), round(r.y, 6), r.z) for r in net.carriers(points).collect())
    assert [(i, leg, x) for i, leg, x, _, _ in got] == [(0, 0, 0.0), (1, 0, 77.5), (2, 0, 155.0), (3, 1, 167.5), (4, 1, 90.0), (5, 1, 12.5)]
    assert {(leg, y, z) for _, leg, _, y, z in got} == {(0, 7.678, 22.589), (1, -7.678, 22.589)}


def test_lift_pylons_beyond_the_border_stand_on_the_next_patch(spark):
    names = ", ".join(f"{n}{k} double" for k in (1, 2, 3) for n in "xyz")
    level = lambda patch, z: [(patch, 0, -2880.0, -2880.0, z, 2880.0, -2880.0, z, 2880.0, 2880.0, z), (patch, 1, -2880.0, -2880.0, z, 2880.0, 2880.0, z, -2880.0, 2880.0, z)]
    tri = spark.createDataFrame(level("001001", 10.0) + level("002001", 50.0), f"patch_id string, tri int, {names}")
    points = spark.createDataFrame([("001001", "in", 0.0, 0.0), ("001001", "east", 2900.0, 0.0), ("001001", "north", 0.0, 2900.0)], "patch_id string, point_id string, px double, py double")
    assert {r.point_id: r.z for r in terrain.surface(points, tri, ["point_id"], 5760.0).collect()} == {"in": 10.0, "east": 50.0, "north": 10.0}


def test_runway_tag_before_distance(spark):
    frame = spark.createDataFrame([("1200 m",), ("x",), (None,)], "tag string")
    got = [r[0] for r in frame.select(places.runway_length(F.col("tag"), F.lit(45.0), F.lit(15.0), F.lit(45.01), F.lit(15.0))).collect()]
    assert got == pytest.approx([1200.0, 1113.2, 1113.2])


def test_areas_at_their_limits(spark):
    """Rotated houses of exactly 360 and 300 square metres have those areas wherever they stand."""
    from terralith.functions import roofs

    rows = []
    for k, (width, height, limits) in enumerate([(20, 18, None), (24, 15, None), (15, 20, roofs.CLI_HOUSE)] * 40):
        c, s = ((1, 0), (0.6, 0.8), (5 / 13, 12 / 13), (8 / 17, 15 / 17))[k % 4]
        x0, y0 = (k * 7919) % 5760 - 2880 + k / 7, (k * 104729) % 5760 - 2880 - k / 3
        ring = [{"x": x0 + c * u - s * v, "y": y0 + s * u + c * v} for u, v in ((0, 0), (width, 0), (width, height), (0, height))]
        rows.append((k, ring, [], width * height))
    kind = "array<struct<x double, y double>>".replace("x double", "x: double").replace("y double", "y: double")
    table = spark.createDataFrame(rows, f"k int, outer {kind}, holes array<{kind}>, exact int")
    found = fo.measured(table).select("k", "area", "exact", roofs.house_scale(F.col("area"), F.col("obb_length"), F.col("obb_width"), F.col("aspect")).alias("scale")).collect()
    assert all(r.area == r.exact and r.scale == "ok" for r in found)


def test_block_elevations_equal_the_join(spark):
    """A rough mesh of odd triangles with a gap: every building's floor as by a join of its samples to the triangles, over many blocks."""
    rng = random.Random(6)
    step, n = 40.0, 12
    at = {(i, j): (i * step + rng.uniform(-15, 15) - 200, j * step + rng.uniform(-15, 15) - 200, rng.uniform(50, 90)) for i in range(n + 1) for j in range(n + 1)}
    tri = []
    for i in range(n):
        for j in range(n):
            a, b, c, d = at[i, j], at[i + 1, j], at[i + 1, j + 1], at[i, j + 1]
            if (i, j) != (5, 5):
                tri += [("p", len(tri), *a, *b, *c), ("p", len(tri) + 1, *a, *c, *d)]
    names = ", ".join(f"{a}{k} double" for k in (1, 2, 3) for a in "xyz")
    ground = spark.createDataFrame(tri, f"patch_id string, tri int, {names}")
    rows = []
    for k in range(120):
        x, y, w, h = rng.uniform(-230, 280), rng.uniform(-230, 280), rng.uniform(1, 60), rng.uniform(1, 60)
        ring = [{"x": x + u, "y": y + v} for u, v in ((0.0, 0.0), (w, 0.0), (w, h), (0.0, h))]
        rows.append(("p" if k % 9 else "q", str(k), ring, []))
    rows += [("p", "none", None, []), ("p", "empty", [], [])]
    houses = spark.createDataFrame(rows, "patch_id string, osm_id string, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    key = ["patch_id", "osm_id"]
    joined = terrain.elevations(terrain.sample_grid(houses), ground, [*key, "px", "py"]).groupBy(*key).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("*").alias("n"))
    want = {r.osm_id: (r.low, r.high, r.n) for r in joined.collect()}
    for block in (960.0, 50.0):
        found = {r.osm_id: r for r in terrain.floors(houses, ground, block=block).collect()}
        assert set(found) == {r[1] for r in rows} and len(want) > 60
        for name, r in found.items():
            if name in want:
                assert (r.min_z, r.max_z, r.samples) == pytest.approx(want[name]) and r.floor_z == pytest.approx(want[name][0] - 0.3)
            else:
                assert r.samples == 0
        assert found["none"].floor_z == found["empty"].floor_z == 0


def test_numbers_without_sorting_a_group(spark):
    from terralith.operators.numbering import numbered

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), rng.randrange(10**6)) for _ in range(3000)] + [("d", 1)]
    want = sorted((g, v, sorted(x for h, x in rows if h == g).index(v) + 1) for g, v in set(rows) if rows.count((g, v)) == 1)
    got = {(r.g, r.v): r.nth for r in numbered(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], ["v"]).collect()}
    assert all(got[g, v] == n for g, v, n in want)


@pytest.mark.parametrize("together", [True, False])
def test_corners_of_small_groups(spark, together):
    """Numbers and marks as by sorting each building's points; groups go over batches."""
    rng = random.Random(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows, want = [], {}
    for b in range(40):
        points = [(round(rng.uniform(-5, 5), 3), round(rng.uniform(-5, 5), 3), float(rng.randrange(3))) for _ in range(6)]
        faces = [[rng.choice(points) for _ in range(rng.choice([3, 4, 5]))] for _ in range(rng.choice([1, 3, 20]))]
        number = {p: k for k, p in enumerate(sorted({p for f in faces for p in f}), 1)}
        for k, f in enumerate(faces):
            rows.append(("p", str(b), k, [{"x": x + 0.00001, "y": y, "z": z} for x, y, z in f]))
        kept = sorted((k, f.index(p), number[p]) for k, f in enumerate(faces) if len(set(f)) >= 3 for p in set(f))
        want[str(b)] = (len(number), kept)
    faces = spark.createDataFrame(rows, "patch_id string, osm_id string, part int, corners array<struct<x:double,y:double,z:double>>").coalesce(1)
    found = pa.indexed_corners(faces, ["patch_id", "osm_id"], ["osm_id", "part"], together).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for b, (n, kept) in want.items():
        own = [r for r in found if r.osm_id == b]
        assert sorted((r.part, r.corner, r.vertex_id) for r in own if r.corner is not None) == kept
        assert sorted(r.vertex_id for r in own if r.own) == list(range(1, n + 1))


def test_grid_elevations_equal_the_sql_to_the_last_bit(spark):
    """A clearance may meet its limit exactly, so heights have to be those of the SQL, not close to them."""
    import duckdb

    from terralith.plans import place_queries as pl

    data = "/root/testdata/sf0.001"
    points = spark.range(4000).selectExpr("'000000' AS patch_id", "id", "id * 7919 % 23200 / 4.0D - 2900 AS px", "id * 104729 % 23200 / 4.0D - 2900 AS py")
    got = {r.id: r.z for r in terrain.grid_elevations(points, pl.triangles(spark, data), ["id"], pl.CELL_M).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as from '{data}/orders.parquet'")
    source = "sp AS (SELECT '000000' AS patch_id, id, id * 7919 % 23200 / 4.0::DOUBLE - 2900 AS px, id * 104729 % 23200 / 4.0::DOUBLE - 2900 AS py FROM range(4000) t(id))"
    want = dict(con.execute(f"WITH {source}, {pl.TERRAIN_SQL}, {pl.elevation_sql('sp', 'zz')} SELECT id, z FROM zz WHERE z IS NOT NULL").fetchall())
    assert got == want and len(got) > 3500
