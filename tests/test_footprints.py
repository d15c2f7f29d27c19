"""Hand-computed rings, sizes and roofs."""

import pytest
from pyspark.sql import functions as F

from terralith.functions import rings, roofs, tags
from terralith.operators import elements as el
from terralith.operators import footprints as fo
from terralith.operators import panels as pa

SCHEMA = "patch_id string, osm_id string, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, building_tag string, levels_tag string, height_tag string, roof_shape_tag string, roof_direction_tag string, roof_angle_tag string"


def building(spark, outer, holes=(), **kw):
    row = ("000000", "1", list(outer), [list(h) for h in holes], *(kw.get(k) for k in ("building", "levels", "height", "shape", "direction", "angle")))
    frame = spark.createDataFrame([row], SCHEMA)
    return pa.textured(fo.classified(fo.attributed(fo.measured(frame))))


def one(spark, outer, holes=(), **kw):
    return building(spark, outer, holes, **kw).first()


RECT = [(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0)]


def test_rectangle(spark):
    r = one(spark, RECT, building="house")
    assert (r.area, r.perimeter, r.vertices, r.convex, r.rectangle_like) == (80.0, 36.0, 4, True, True)
    assert (r.eligibility, r.scale, r.actual_roof, r.fallback_reason) == ("eligible", "ok", "gabled", "none")
    assert (r.floors, r.height_m) == (2, 6.0)


def test_area_does_not_depend_on_start_or_rotation(spark):
    turned = [(0.6 * x - 0.8 * y, 0.8 * x + 0.6 * y) for x, y in RECT[2:] + RECT[:2]]
    assert one(spark, turned).area == pytest.approx(80.0)


def test_clockwise_collinear_input(spark):
    ring = [(0.0, 0.0), (0.0, 8.0), (10.0, 8.0), (10.0, 0.0), (5.0, 0.0)]
    frame = spark.createDataFrame([(ring,)], "outer array<struct<x:double,y:double>>")
    got = frame.select(rings.without_collinear(rings.wound(F.col("outer"))).alias("r")).select(F.size("r").alias("n"), rings.signed_area(F.col("r")).alias("a")).first()
    assert (got.n, got.a) == (4, 80.0)


@pytest.mark.parametrize(
    "outer, holes, reason",
    [
        ([(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (4.0, 4.0), (4.0, 9.0), (0.0, 9.0)], [], "too_many_vertices"),
        ([(0.0, 0.0), (10.0, 5.0), (0.0, 10.0), (4.0, 5.0)], [], "not_convex"),
        ([(0.0, 0.0), (10.0, 0.0), (6.0, 9.0), (4.0, 9.0)], [], "not_rectangular_enough"),
        ([(0.0, 0.0), (10.0, 0.0), (15.0, 8.66), (5.0, 8.66)], [], "not_rectangle_angles"),
        (RECT, [[(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0)]], "has_holes"),
        ([(0.0, 0.0), (40.0, 0.0), (40.0, 5.0), (0.0, 5.0)], [], "bad_aspect_ratio"),
    ],
)
def test_eligibility(spark, outer, holes, reason):
    assert one(spark, outer, holes).eligibility == reason


@pytest.mark.parametrize(
    "given, floors, height, clamped",
    [
        ({"levels": "233"}, 60, 180.0, True),
        ({"levels": "2.5", "building": "house"}, 2, 6.0, False),
        ({"levels": "0", "building": "house"}, 1, 0.0, False),
        ({"height": "12 m"}, 4, 12.0, False),
        ({"height": "7.5"}, 2, 7.5, False),
        ({"height": "abc", "building": "house"}, 2, 6.0, False),
        ({"height": "900"}, 67, 200.0, True),
    ],
)
def test_size(spark, given, floors, height, clamped):
    r = one(spark, RECT, **given)
    if given.get("height") == "900":
        floors = 60  # 300 floors by height, clamped to 60 first
    assert (r.floors, r.height_m, r.clamped) == (floors, height, clamped)


def test_roof_shapes(spark):
    frame = spark.createDataFrame([(x,) for x in (None, "gabled", "pyramidal", " Skillion ", "onion")], "s string")
    assert [r[0] for r in frame.select(tags.roof_shape(F.col("s"))).collect()] == ["gabled", "gabled", "hipped", "flat", "gabled"]


def test_hipped_but_too_large_falls_back_without_a_reason(spark):
    r = one(spark, [(0.0, 0.0), (35.0, 0.0), (35.0, 10.0), (0.0, 10.0)], shape="hipped", levels="1")
    assert (r.roof_asked, r.actual_roof, r.fallback_reason) == ("hipped", "flat", "none")


def test_patch_border(spark):
    at = lambda x: building(spark, [(a + x, b) for a, b in RECT]).select(fo.patch_status(F.col("bbox"))).first()[0]
    assert [at(0.0), at(2875.0), at(4000.0)] == ["kept", "partially_outside_patch", "outside_patch_bounds"]


def test_wall_area_is_edge_length_times_height(spark):
    walls = pa.floor_panels(building(spark, RECT, levels="3").withColumn("floor_z", F.lit(0.0)))
    assert walls.count() == 12 and walls.select(F.sum(pa.face_area(F.col("corners")))).first()[0] == pytest.approx(36 * 9)


def test_outward_is_idempotent(spark):
    b = building(spark, RECT).withColumn("floor_z", F.lit(0.0))
    once = pa.outward(pa.side_walls(b.withColumn("outer", F.reverse("outer"))), b)
    assert once.where("reversed").count() == 4
    assert pa.outward(once.drop("reversed"), b).where("reversed").count() == 0


def test_shared_vertices_drops_collapsed_faces(spark):
    rows = [("p", "b", 0, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]), ("p", "b", 1, [(0.0, 0.0, 0.0), (1.00004, 0.0, 0.0), (1.0, 0.0, 0.0)])]
    faces = spark.createDataFrame(rows, "patch_id string, osm_id string, part int, corners array<struct<x:double,y:double,z:double>>")
    vertices, corners = pa.shared_vertices(faces, ["patch_id", "osm_id"], ["osm_id", "part"])
    assert vertices.count() == 3 and corners.select("part").distinct().count() == 1


def test_courtyard_relation(spark):
    ring = {"a": (0.0, 0.0), "b": (10.0, 0.0), "c": (10.0, 10.0), "d": (0.0, 10.0), "e": (3.0, 3.0), "f": (6.0, 3.0), "g": (6.0, 6.0)}
    nodes = spark.createDataFrame([("000000", k, y, x, {}) for k, (x, y) in ring.items()], "patch_id string, node_id string, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame(
        [("000000", "1", ["c", "b"], {"building": "yes"}), ("000000", "2", ["c", "d", "a"], {}), ("000000", "3", ["a", "b"], {}), ("000000", "4", ["e", "f", "g", "e"], {}), ("000000", "5", ["a", "b", "zz", "c"], {"building": "yes"}), ("000000", "6", ["a", "b"], {"building": "yes"})],
        "patch_id string, way_id string, refs array<string>, tags map<string,string>",
    )
    relations = spark.createDataFrame(
        [("000000", "9", [("way", "2", ""), ("way", "1", "outer"), ("way", "3", "outer"), ("way", "4", "inner")], {"type": "multipolygon", "building": "house"}), ("000000", "8", [("way", "2", "outer")], {"type": "multipolygon", "building": "house"})],
        "patch_id string, rel_id string, members array<struct<type:string,ref:string,role:string>>, tags map<string,string>",
    )
    found = {r.osm_id: r for r in el.buildings(nodes, ways, relations).select("*", rings.area(F.col("outer"), F.col("holes")).alias("area")).collect()}
    assert set(found) == {"9", "5"}
    assert found["9"].area == pytest.approx(100 - 4.5) and found["9"].kind == "relation"
    assert len(found["5"].outer) == 3
    assert [r.node_id for r in el.missing_refs(ways, nodes).collect()] == ["zz"]
    _, rejected = el.way_rings(el.way_points(ways.where("way_id = '6'"), nodes))
    assert rejected.count() == 1


def test_mast_is_no_building(spark):
    t = spark.createDataFrame([({"building": "yes", "communication:radio": "yes", "man_made": "mast"},), ({"building": "yes"},)], "tags map<string,string>")
    assert [tuple(r) for r in t.select(el.is_building(F.col("tags")), el.is_transmitter(F.col("tags"))).collect()] == [(False, True), (True, False)]


def test_limits_of_the_command_line(spark):
    frame = spark.createDataFrame([(330.0, 27.0, 12.2)], "a double, l double, w double")
    got = frame.select(roofs.house_scale(F.col("a"), F.col("l"), F.col("w"), F.lit(2.2)), roofs.house_scale(F.col("a"), F.col("l"), F.col("w"), F.lit(2.2), roofs.CLI_HOUSE)).first()
    assert tuple(got) == ("ok", "too_long_side")


def test_partitions_keep_their_size(spark):
    from terralith.plans.derived import PART_ROWS, spread

    sizes = spread(spark.range(0, 8 * PART_ROWS, 1, 4).withColumnRenamed("id", "k"), "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1.1 * PART_ROWS
