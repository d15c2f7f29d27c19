"""Queries over footprints, one or more for each inventory id, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions import kernels, rings, roofs, tags
from terralith.operators import footprints as fo
from terralith.plans.derived import FOOTPRINTS_SQL, footprints

Q: dict = {}
O: dict = {}  # noqa: E741


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        O[name] = f"WITH {FOOTPRINTS_SQL}{sql}"


def _full(spark, sf):
    every = fo.classified(fo.attributed(fo.measured(footprints(spark, sf))))
    return fo.computed(every, {"filter_reason": fo.patch_status(F.col("bbox"))})


r6 = lambda c: F.round(c, 6) + F.lit(0.0)

MEASURES_SQL = """
, shoelace AS (SELECT osm_id, ring_no, sum((x - fx) * (y2 - fy) - (x2 - fx) * (y - fy)) / 2 AS sa, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS per, count(*) AS n, min(x) AS min_x,
  max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, avg(x) AS mx, avg(y) AS my,
    bool_and(((x - x0) * (y2 - y) - (y - y0) * (x2 - x)) > 0) OR bool_and(((x - x0) * (y2 - y) - (y - y0) * (x2 - x)) < 0) AS convex,
    bool_and(abs(acos(greatest(-1, least(1,
      ((x0 - x) * (x2 - x) + (y0 - y) * (y2 - y)) / (sqrt((x0 - x) * (x0 - x) + (y0 - y) * (y0 - y)) * sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))))) - pi() / 2) <= radians(25)) AS right_angles
  FROM edges GROUP BY ALL),
axis AS (SELECT osm_id, degrees(atan2(y2 - y, x2 - x)) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY osm_id
  ORDER BY round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 6) DESC, pos) AS r FROM edges WHERE ring_no = 0) WHERE r = 1),
turned AS (SELECT rv.osm_id, raw - floor(raw / 180) * 180 AS axis_deg,
  max(x * cos(radians(raw)) + y * sin(radians(raw))) - min(x * cos(radians(raw)) + y * sin(radians(raw))) AS ol,
  max(y * cos(radians(raw)) - x * sin(radians(raw))) - min(y * cos(radians(raw)) - x * sin(radians(raw))) AS ow FROM rv JOIN axis USING (osm_id) WHERE ring_no = 0
  GROUP BY ALL),
m0 AS (SELECT fp.patch_id, fp.osm_id, fp.k, fp.has_hole, round(abs(o.sa) - coalesce(abs(i.sa), 0), 9) AS area, o.per AS perimeter, o.n AS vertices, o.min_x, o.max_x, o.min_y,
  o.max_y, o.mx, o.my, o.convex, o.n = 4 AND o.right_angles AS rect, t.axis_deg, round(greatest(ol, ow), 9) AS ol, round(least(ol, ow), 9) AS ow, round(greatest(ol,
  ow) / least(ol, ow), 9) AS aspect, ol * ow AS box, building_tag, levels_tag, height_tag, roof_shape_tag, roof_direction_tag, roof_angle_tag
  FROM fp JOIN shoelace o ON o.osm_id = fp.osm_id AND o.ring_no = 0 LEFT JOIN shoelace i ON i.osm_id = fp.osm_id AND i.ring_no = 1 JOIN turned t ON t.osm_id = fp.osm_id),
m AS (SELECT *, round(area / box, 9) AS fill, CASE WHEN min_x >= -2880 AND max_x <= 2880 AND min_y >= -2880 AND max_y <= 2880 THEN 'kept'
  WHEN max_x < -2880 OR min_x > 2880 OR max_y < -2880 OR min_y > 2880 THEN 'outside_patch_bounds' ELSE 'partially_outside_patch' END AS filter_reason FROM m0)
"""
ATTRIBUTES_SQL = MEASURES_SQL + """
, c0 AS (SELECT *, CASE WHEN building_tag IN ('house', 'detached') THEN 'house' WHEN building_tag = 'apartments' THEN 'apartment'
  WHEN building_tag = 'warehouse' THEN 'industrial' WHEN building_tag = 'retail' THEN 'commercial' ELSE 'other' END AS category,
    CASE WHEN roof_shape_tag = 'flat' THEN 'flat' WHEN roof_shape_tag IN ('hipped', 'pyramidal') THEN 'hipped' ELSE 'gabled' END AS shape_asked,
      CAST(trim(replace(height_tag, 'm', '')) AS double) AS tagged_height, CAST(levels_tag AS integer) AS levels FROM m),
c1 AS (SELECT *, CASE category WHEN 'industrial' THEN 1 WHEN 'apartment' THEN CASE WHEN area > 500 THEN 4 WHEN area > 200 THEN 3 ELSE 2 END WHEN 'commercial' THEN CASE
  WHEN area > 200 THEN 2 ELSE 1 END WHEN 'house' THEN 2 ELSE CASE WHEN area > 300 THEN 3 WHEN area > 100 THEN 2 ELSE 1 END END AS guess FROM c0),
c2 AS (SELECT *, coalesce(levels, CASE WHEN tagged_height IS NULL THEN guess ELSE greatest(1, CAST(round_even(tagged_height / 3, 0) AS integer)) END) AS f0 FROM c1),
c3 AS (SELECT *, least(f0, 60) AS f1, CASE WHEN f0 > 60 AND tagged_height IS NULL THEN 180.0 WHEN tagged_height IS NOT NULL THEN tagged_height
  WHEN f0 <> guess THEN f0 * 3.0 WHEN category = 'industrial' THEN 6.0 ELSE guess * 3.0 END::double AS h1 FROM c2),
c AS (SELECT *, greatest(1, CASE WHEN h1 > 200 THEN least(f1, 67) ELSE f1 END) AS floors, least(h1, 200.0)::double AS height_m, f0 > 60 OR h1 > 200 AS clamped FROM c3)
"""
CLASSES_SQL = ATTRIBUTES_SQL + """
, d0 AS (SELECT *, CASE WHEN shape_asked <> 'gabled' THEN shape_asked WHEN category = 'industrial' THEN 'flat' WHEN category = 'commercial' THEN CASE
  WHEN floors > 2 OR height_m > 8 THEN 'flat' ELSE 'gabled' END
      WHEN category = 'apartment' THEN CASE WHEN floors > 3 OR height_m > 10 THEN 'flat' ELSE 'gabled' END WHEN category = 'house' THEN CASE WHEN floors > 2 THEN 'flat' ELSE 'gabled' END
      WHEN area < 200 THEN 'gabled' WHEN area < 400 AND floors <= 2 AND height_m <= 8 THEN 'gabled' ELSE 'flat' END AS roof_asked,
    CASE WHEN has_hole THEN 'has_holes' WHEN vertices > 4 THEN 'too_many_vertices' WHEN NOT convex THEN 'not_convex' WHEN NOT rect THEN 'not_rectangle_angles'
      WHEN fill < 0.7 THEN 'not_rectangular_enough' WHEN aspect < 0.2 OR aspect > 6 THEN 'bad_aspect_ratio' ELSE 'eligible' END AS eligibility,
    CASE WHEN ow < 3.2 THEN 'too_short_side' WHEN ol > 30 THEN 'too_long_side' WHEN area > 360 THEN 'too_large_area' WHEN aspect > 4.8 THEN 'too_elongated' ELSE 'ok' END AS scale FROM c),
d1 AS (SELECT *, CASE WHEN roof_asked = 'flat' OR floors > 2 OR eligibility <> 'eligible' OR scale <> 'ok' THEN 'flat' ELSE roof_asked END AS actual_roof,
    CASE WHEN roof_asked = 'flat' THEN 'none' WHEN floors > 2 THEN 'too_many_floors' WHEN eligibility <> 'eligible' THEN eligibility WHEN roof_asked = 'gabled'
      AND scale <> 'ok' THEN scale ELSE 'none' END AS fallback_reason,
    eligibility = 'too_many_vertices' AND vertices <= 12 AND NOT has_hole AND scale = 'ok' AND floors <= 2 AS skeleton FROM d0),
d AS (SELECT *, CASE WHEN category IN ('apartment', 'commercial') OR (category = 'other' AND area <= 200) OR (category = 'house'
  AND actual_roof = 'flat') THEN 'highrise' ELSE 'plain' END AS wall_kind,
    (('0x' || right(sha256(osm_id), 8))::BIGINT & 2147483647) + 12345 AS seed FROM d1)
"""

add("flagship_roof_report", lambda s, d: _full(s, d).where("filter_reason = 'kept'").groupBy("category", "roof_asked").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("total_area")),
    CLASSES_SQL + "SELECT category, roof_asked, count(*) AS n, round(sum(area), 3) AS total_area FROM d WHERE filter_reason = 'kept' GROUP BY ALL")

add("w1_ring_edges", lambda s, d: footprints(s, d).select("osm_id", F.explode(rings.edges(F.col("outer"))).alias("e"))
    .select("osm_id", F.col("e.pos").cast("bigint").alias("pos"), *[r6(F.col(f"e.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")]),
    "SELECT osm_id, pos::BIGINT AS pos, round(x, 6) + 0 AS x1, round(y, 6) + 0 AS y1, round(x2, 6) + 0 AS x2, round(y2, 6) + 0 AS y2 FROM edges WHERE ring_no = 0")
add("w2_vertex_triples", lambda s, d: footprints(s, d).select("osm_id", F.explode(rings.triples(F.col("outer"))).alias("e"))
    .select("osm_id", F.col("e.pos").cast("bigint").alias("pos"), *[r6(F.col(f"e.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1", "x2", "y2")]),
    "SELECT osm_id, pos::BIGINT AS pos, round(x0, 6) + 0 AS x0, round(y0, 6) + 0 AS y0, round(x, 6) + 0 AS x1, round(y, 6) + 0 AS y1, round(x2, 6) + 0 AS x2, round(y2, "
    "6) + 0 AS y2 FROM edges WHERE ring_no = 0")
add("w3_wound_holes", lambda s, d: footprints(s, d).select("osm_id", F.explode("holes").alias("hole"))
    .select("osm_id", r6(rings.signed_area(rings.wound(F.reverse("hole"), False))).alias("area"),
    F.size(rings.closed(F.col("hole"))).cast("bigint").alias("points")),
    MEASURES_SQL + "SELECT osm_id, round(-abs(sa), 6) + 0 AS area, n + 1 AS points FROM shoelace WHERE ring_no = 1")
_dense = lambda ring: F.flatten(F.transform(rings.edges(ring),
    lambda e: F.array(F.struct(e["x1"].alias("x"), e["y1"].alias("y")),
    F.struct(((e["x1"] + e["x2"]) / 2).alias("x"), ((e["y1"] + e["y2"]) / 2).alias("y")))))
add("w4_without_collinear", lambda s, d: footprints(s, d).select("osm_id", rings.without_collinear(_dense(F.col("outer"))).alias("left"))
    .select("osm_id", F.size("left").cast("bigint").alias("n"), r6(kernels.signed_area("left")).alias("area")),
    MEASURES_SQL + "SELECT osm_id, n, round(sa, 6) + 0 AS area FROM shoelace WHERE ring_no = 0")
add("a1_area", lambda s, d: fo.measured(footprints(s, d)).select("osm_id", r6(F.col("area")).alias("area")), MEASURES_SQL + "SELECT osm_id, round(area, 6) + 0 AS area FROM m")
add("a2_perimeter", lambda s, d: fo.measured(footprints(s, d)).select("osm_id", r6(F.col("perimeter")).alias("perimeter")), MEASURES_SQL + "SELECT osm_id, round(perimeter, 6) + 0 AS perimeter FROM m")
add("a3_bbox", lambda s, d: fo.measured(footprints(s, d)).select("osm_id", *[r6(F.col(f"bbox.{c}")).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]),
    MEASURES_SQL + "SELECT osm_id, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("min_x", "min_y", "max_x", "max_y")) + " FROM m")
add("a4_centroids", lambda s, d: footprints(s, d).withColumns({"o": rings.vertex_mean(F.col("outer")), "c": rings.closed_mean(F.col("outer"))})
    .select("osm_id", r6(F.col("o.x")).alias("open_x"), r6(F.col("o.y")).alias("open_y"), r6(F.col("c.x")).alias("closed_x"), r6(F.col("c.y")).alias("closed_y")),
    "SELECT osm_id, round(avg(x), 6) + 0 AS open_x, round(avg(y), 6) + 0 AS open_y, round((sum(x) + max(x) FILTER (pos = 0)) / (count(*) + 1), 6) + 0 AS closed_x, "
    "round((sum(y) + max(y) FILTER (pos = 0)) / (count(*) + 1), 6) + 0 AS closed_y FROM rv WHERE ring_no = 0 GROUP BY osm_id")
add("a5_vertices", lambda s, d: fo.measured(footprints(s, d)).groupBy("vertices").agg(F.count("*").alias("n"))
    .select(F.col("vertices").cast("bigint").alias("vertices"), "n"), MEASURES_SQL + "SELECT vertices, count(*) AS n FROM m GROUP BY ALL")
add("a6_convex", lambda s, d: fo.measured(footprints(s, d)).select("osm_id", "convex"), MEASURES_SQL + "SELECT osm_id, convex FROM m")
add("a7_axis", lambda s, d: fo.measured(footprints(s, d)).select("osm_id", r6(F.col("axis_deg")).alias("axis_deg")), MEASURES_SQL + "SELECT osm_id, round(axis_deg, 6) + 0 AS axis_deg FROM m")
add("a8_oriented_box", lambda s, d: fo.measured(footprints(s, d)).select("osm_id", *[r6(F.col(c)).alias(c) for c in ("obb_length", "obb_width", "aspect", "fill")]),
    MEASURES_SQL + "SELECT osm_id, round(ol, 6) + 0 AS obb_length, round(ow, 6) + 0 AS obb_width, round(aspect, 6) + 0 AS aspect, round(fill, 6) + 0 AS fill FROM m")
add("a9_rectangle_like", lambda s, d: fo.measured(footprints(s, d)).select("osm_id", "rectangle_like"), MEASURES_SQL + "SELECT osm_id, rect AS rectangle_like FROM m")
add("a11_longest_diagonal", lambda s, d: footprints(s, d).select("osm_id", r6(rings.longest_diagonal(F.col("outer"))).alias("diagonal")),
    "SELECT p.osm_id, round(max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 6) + 0 AS diagonal FROM rv p JOIN rv q ON p.osm_id = q.osm_id "
    "AND p.ring_no = 0 AND q.ring_no = 0 GROUP BY ALL")
add("a12_vertex_histogram", lambda s, d: fo.measured(footprints(s, d)).groupBy(fo.vertex_bucket(F.col("vertices")).alias("bucket")).agg(F.count("*").alias("n")),
    MEASURES_SQL + "SELECT CASE WHEN vertices = 4 THEN '4' WHEN vertices <= 6 THEN '5_to_6' WHEN vertices <= 8 THEN '7_to_8' ELSE '9_plus' END AS bucket, count(*) AS n FROM m GROUP BY ALL")
add("a13_patch_report", lambda s, d: fo.report(_full(s, d)),
    CLASSES_SQL + """SELECT patch_id, count(*) AS parsed, count_if(filter_reason <> 'kept')::BIGINT AS filtered, count_if(filter_reason = 'kept')::BIGINT AS processed,
  count_if(filter_reason = 'kept' AND eligibility = 'eligible')::BIGINT AS eligible, count_if(filter_reason = 'kept' AND scale = 'ok')::BIGINT AS house_scale,
    count_if(filter_reason = 'kept' AND actual_roof = 'gabled')::BIGINT AS gabled, count_if(filter_reason = 'kept' AND actual_roof = 'hipped')::BIGINT AS hipped,
      count_if(filter_reason = 'kept' AND actual_roof = 'flat')::BIGINT AS flat, count_if(filter_reason = 'kept' AND roof_asked <> actual_roof)::BIGINT AS fallbacks,
    count_if(filter_reason = 'kept' AND skeleton)::BIGINT AS skeleton_candidates, count_if(filter_reason = 'kept' AND clamped)::BIGINT AS clamped_sizes FROM d GROUP BY ALL""")
add("a14_fallback_map", lambda s, d: fo.fallback_map(_full(s, d)).select("patch_id", F.to_json("fallbacks").alias("fallbacks")),
    CLASSES_SQL + ", g AS (SELECT patch_id, fallback_reason, count(*) AS n FROM d WHERE filter_reason = 'kept' AND roof_asked <> actual_roof GROUP BY ALL) SELECT patch_id, '{' || string_agg('\"' || fallback_reason || '\":' || n, ',' ORDER BY fallback_reason) || '}' AS fallbacks FROM g GROUP BY ALL")
add("a19_run_summary", lambda s, d: fo.report(_full(s, d)).rollup(F.substring("patch_id", 1, 3).alias("landscape"), "patch_id")
    .agg(F.sum("processed").alias("processed"), F.sum("gabled").alias("gabled"), F.sum("flat").alias("flat")),
    CLASSES_SQL + "SELECT left(patch_id, 3) AS landscape, patch_id, count_if(filter_reason = 'kept')::BIGINT AS processed, count_if(filter_reason = 'kept' "
    "AND actual_roof = 'gabled')::BIGINT AS gabled, count_if(filter_reason = 'kept' AND actual_roof = 'flat')::BIGINT AS flat FROM d GROUP BY ROLLUP (left(patch_id, "
    "3), patch_id)")
add("a25_ring_quality", lambda s, d: footprints(s, d).select("osm_id",
    (F.size(F.array_distinct(F.transform("outer", lambda p: F.struct(F.round(p["x"], 6), F.round(p["y"], 6))))) < F.size("outer")).alias("repeated_point"),
    (F.abs(rings.signed_area(F.col("outer"))) < 0.01).alias("zero_area"),
    F.exists(rings.edges(F.col("outer")), lambda e: rings.length(e) < 1e-6).alias("repeated_neighbour")),
    "SELECT osm_id, count(DISTINCT (round(x, 6), round(y, 6))) < count(*) AS repeated_point, abs(sum(x * y2 - x2 * y) / 2) < 0.01 AS zero_area, "
    "bool_or(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) < 1e-6) AS repeated_neighbour FROM edges WHERE ring_no = 0 GROUP BY osm_id")

add("p2_category", lambda s, d: footprints(s, d).groupBy("building_tag", tags.category(F.col("building_tag")).alias("category")).agg(F.count("*").alias("n")),
    ATTRIBUTES_SQL + "SELECT building_tag, category, count(*) AS n FROM c GROUP BY ALL")
add("p3_roof_shape", lambda s, d: footprints(s, d).groupBy("roof_shape_tag", tags.roof_shape(F.col("roof_shape_tag")).alias("roof_shape"))
    .agg(F.count("*").alias("n")), ATTRIBUTES_SQL + "SELECT roof_shape_tag, shape_asked AS roof_shape, count(*) AS n FROM c GROUP BY ALL")
add("p4_height", lambda s, d: footprints(s, d).select("osm_id", tags.height(F.col("height_tag")).alias("height_m")), ATTRIBUTES_SQL + "SELECT osm_id, tagged_height AS height_m FROM c")
add("p5_p7_size", lambda s, d: fo.attributed(fo.measured(footprints(s, d))).select("osm_id", "floors", "height_m", "clamped"), ATTRIBUTES_SQL + "SELECT osm_id, floors, height_m, clamped FROM c")
add("p6_estimate", lambda s, d: fo.attributed(fo.measured(footprints(s, d)))
    .select("osm_id", tags.estimated_floors(F.col("area"), F.col("category")).alias("floors"),
    tags.estimated_height(F.col("area"), F.col("category")).alias("height_m")),
    ATTRIBUTES_SQL + "SELECT osm_id, guess AS floors, CASE WHEN category = 'industrial' THEN 6.0 ELSE guess * 3.0 END::double AS height_m FROM c")
add("p8_p9_roof_pitch_direction", lambda s, d: fo.attributed(fo.measured(footprints(s, d)))
    .select("osm_id", "pitch", F.col("direction.degrees").alias("degrees"), F.col("direction.source").alias("direction_source")),
    "SELECT osm_id, coalesce(greatest(30, least(60, roof_angle_tag::double)), 45)::double AS pitch, roof_direction_tag::double % 360 AS degrees, CASE "
    "WHEN roof_direction_tag IS NULL THEN 'longest_axis_heuristic' ELSE 'osm_tag' END AS direction_source FROM fp")
add("p10_seed", lambda s, d: footprints(s, d).select("osm_id", tags.stable_seed(F.col("osm_id")).alias("seed")), CLASSES_SQL + "SELECT osm_id, seed FROM d")
add("p11_variation", lambda s, d: footprints(s, d).withColumn("seed", tags.stable_seed(F.col("osm_id")))
    .select("osm_id", tags.variation(F.col("seed"), 6, "roof").alias("roof"), tags.variation(F.col("seed"), 12, "facade").alias("facade")),
    CLASSES_SQL + "SELECT osm_id, ((('0x' || right(sha256(seed || 'roof'), 8))::BIGINT & 2147483647) % 6)::INT AS roof, ((('0x' || right(sha256(seed || 'facade'), "
    "8))::BIGINT & 2147483647) % 12)::INT AS facade FROM d")
add("p12_flat_bucket", lambda s, d: footprints(s, d).select("osm_id", roofs.flat_bucket(tags.stable_seed(F.col("osm_id"))).alias("bucket"),
    roofs.flat_bucket(F.lit(1), merged=True).alias("merged")), CLASSES_SQL + "SELECT osm_id, (seed % 6 + 1)::INT AS bucket, 1 AS merged FROM d")
add("p13_random_subset", lambda s, d: footprints(s, d).select("osm_id", tags.in_random_subset(tags.stable_seed(F.col("osm_id")), 0.5).alias("chosen")),
    CLASSES_SQL + "SELECT osm_id, (('0x' || right(sha256(seed || 'subset'), 8))::BIGINT & 2147483647) % 1000000 < 500000 AS chosen FROM d")
add("p14_select_roof", lambda s, d: _full(s, d).select("osm_id", "roof_asked",
    roofs.select_roof(F.col("shape_asked"), F.col("category"), F.col("floors"), F.col("height_m"), F.col("area"), "osm_tags_only").alias("by_tags")),
    CLASSES_SQL + "SELECT osm_id, roof_asked, CASE WHEN shape_asked <> 'gabled' THEN shape_asked WHEN category = 'house' AND floors <= 2 THEN 'gabled' ELSE 'flat' END AS by_tags FROM d")
add("p15_eligibility", lambda s, d: _full(s, d).groupBy("eligibility").agg(F.count("*").alias("n")), CLASSES_SQL + "SELECT eligibility, count(*) AS n FROM d GROUP BY ALL")
add("p16_house_scale", lambda s, d: _full(s, d).groupBy("scale",
    roofs.house_scale(F.col("area"), F.col("obb_length"), F.col("obb_width"), F.col("aspect"), roofs.CLI_HOUSE).alias("cli_scale")).agg(F.count("*").alias("n")),
    CLASSES_SQL + "SELECT scale, CASE WHEN ow < 4 THEN 'too_short_side' WHEN ol > 25 THEN 'too_long_side' WHEN area > 300 THEN 'too_large_area' "
    "WHEN aspect > 4 THEN 'too_elongated' ELSE 'ok' END AS cli_scale, count(*) AS n FROM d GROUP BY ALL")
add("p17_skeleton", lambda s, d: _full(s, d).groupBy("skeleton").agg(F.count("*").alias("n")), CLASSES_SQL + "SELECT skeleton, count(*) AS n FROM d GROUP BY ALL")
add("p18_actual_roof", lambda s, d: _full(s, d).select("osm_id", "roof_asked", "actual_roof", "fallback_reason"), CLASSES_SQL + "SELECT osm_id, roof_asked, actual_roof, fallback_reason FROM d")
add("p19_wall_kind", lambda s, d: _full(s, d).select("osm_id", "wall_kind"), CLASSES_SQL + "SELECT osm_id, wall_kind FROM d")
add("p20_a15_mesh_groups", lambda s, d: _full(s, d).withColumns(dict(zip(("wall_group", "roof_group"),
    fo.mesh_group(F.col("wall_kind"), F.col("actual_roof"), roofs.flat_bucket(F.col("seed")))))).groupBy("patch_id", "wall_group", "roof_group")
    .agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area")),
    CLASSES_SQL + "SELECT patch_id, CASE WHEN actual_roof <> 'flat' THEN 'houses' "
    "WHEN wall_kind = 'highrise' THEN 'Highrise_walls' ELSE 'industrial_walls' END AS wall_group, CASE "
    "WHEN actual_roof <> 'flat' THEN 'houses' ELSE 'flat_roof_' || (seed % 6 + 1) END AS roof_group, count(*) AS n, round(sum(area), 3) AS area FROM d GROUP BY ALL")
add("p35_heights", lambda s, d: _full(s, d).select("osm_id", (F.lit(100.0) + F.col("height_m")).alias("wall_top_z"),
    (F.lit(100.0) + F.col("height_m") + F.when(F.col("actual_roof") == "flat", 0.0).otherwise(roofs.GABLE_M)).alias("roof_top_z")),
    CLASSES_SQL + "SELECT osm_id, 100::double + height_m AS wall_top_z, 100::double + height_m + CASE WHEN actual_roof = 'flat' THEN 0 ELSE 3 END AS roof_top_z FROM d")
add("f2_within_patch", lambda s, d: fo.measured(footprints(s, d)).groupBy("patch_id", fo.patch_status(F.col("bbox")).alias("filter_reason"))
    .agg(F.count("*").alias("n")), MEASURES_SQL + "SELECT patch_id, filter_reason, count(*) AS n FROM m GROUP BY ALL")
add("f3_debug_one", lambda s, d: _full(s, d).where("osm_id = '1'").select("osm_id", "category", "actual_roof"), CLASSES_SQL + "SELECT osm_id, category, actual_roof FROM d WHERE osm_id = '1'")
add("f8_bbox_predicates", lambda s, d: fo.measured(footprints(s, d))
    .select("osm_id", ((F.col("bbox.min_x") <= 0) & (F.col("bbox.max_x") >= -500) & (F.col("bbox.min_y") <= 0) & (F.col("bbox.max_y") >= -500)).alias("intersects"),
    ((F.col("bbox.min_x") >= -500) & (F.col("bbox.max_x") <= 0) & (F.col("bbox.min_y") >= -500) & (F.col("bbox.max_y") <= 0)).alias("contained")),
    MEASURES_SQL + "SELECT osm_id, min_x <= 0 AND max_x >= -500 AND min_y <= 0 AND max_y >= -500 AS intersects, min_x >= -500 AND max_x <= 0 AND min_y >= -500 AND max_y <= 0 AS contained FROM m")
add("t2_fallbacks_by_count", lambda s, d: fo.fallback_counts(_full(s, d)).groupBy("fallback_reason").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "fallback_reason"),
    CLASSES_SQL + "SELECT fallback_reason, count(*)::BIGINT AS n FROM d WHERE filter_reason = 'kept' AND roof_asked <> actual_roof GROUP BY ALL ORDER BY n DESC, fallback_reason")
add("t3_top_buildings", lambda s, d: fo.top_buildings(fo.measured(footprints(s, d)).withColumn("area", F.round("area", 6)))
    .select("patch_id", "rank", "osm_id", F.col("vertices").cast("bigint").alias("vertices")),
    MEASURES_SQL + "SELECT patch_id, rank::INT AS rank, osm_id, vertices FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY vertices DESC, round(area, "
    "6) DESC, osm_id) AS rank FROM m) WHERE rank <= 10")
add("point_in_polygon_rules", lambda s, d: footprints(s, d).withColumns({"px": rings.vertex_mean(F.col("outer"))["x"] + 1.25,
    "py": rings.vertex_mean(F.col("outer"))["y"] + 0.75}).select("osm_id", rings.inside_even_odd(F.col("outer"), F.col("px"), F.col("py")).alias("even_odd"),
    rings.inside_or_on_edge(F.col("outer"), F.col("px"), F.col("py")).alias("or_on_edge"),
    rings.inside_winding(F.col("outer"), F.col("px"), F.col("py")).alias("winding")),
    """, q AS (SELECT osm_id, avg(x) + 1.25 AS px, avg(y) + 0.75 AS py FROM rv WHERE ring_no = 0 GROUP BY 1), e AS (SELECT osm_id, sum(CASE WHEN ((y > py) <> (y2 > py))
  AND px < (x2 - x) * (py - y) / (y2 - y) + x THEN 1 ELSE 0 END) % 2 = 1 AS odd, bool_or(abs((px - x) * (y2 - y) - (py - y) * (x2 - x)) <= 1e-9 AND px BETWEEN least(x,
  x2) AND greatest(x, x2) AND py BETWEEN least(y, y2) AND greatest(y, y2)) AS edge,
    sum(CASE WHEN y <= py AND y2 > py AND (x2 - x) * (py - y) - (px - x) * (y2 - y) > 0 THEN 1 WHEN y > py AND y2 <= py
      AND (x2 - x) * (py - y) - (px - x) * (y2 - y) < 0 THEN -1 ELSE 0 END) <> 0 AS wn FROM edges JOIN q USING (osm_id) WHERE ring_no = 0 GROUP BY 1)
    SELECT osm_id, odd AS even_odd, odd OR edge AS or_on_edge, wn AS winding FROM e""")


def convexity_ratio(spark, sf):
    """The share that a footprint has of its convex hull."""
    return fo.convexity(footprints(spark, sf)).select("osm_id", r6(F.col("convexity_ratio")).alias("convexity_ratio"))


# Rectangles and sheared rings are their own hull; an L lacks the triangle between its two inner ends.
add("a11_u1_convexity_ratio", convexity_ratio, MEASURES_SQL + """
, sized AS (SELECT osm_id, shape, 2 * a * 2 * h AS box, a * h AS gap FROM fp)
SELECT osm_id, round(CASE WHEN shape = 'L' THEN (box - gap) / (box - gap / 2) ELSE 1 END, 6) + 0 AS convexity_ratio FROM sized""")


def first_warnings(spark, sf):
    """T4: the first five clamped sizes of each patch with their number (see footprints.warnings)."""
    return fo.warnings(_full(spark, sf), 5).select("patch_id", "nth", "osm_id", "warning", "total")


add("t4_p7_r4_first_warnings", first_warnings, CLASSES_SQL + """
, texts AS (
  SELECT patch_id, osm_id, count(*) OVER (PARTITION BY patch_id) AS total, row_number() OVER (PARTITION BY patch_id ORDER BY k) AS nth,
    'Clamped size of ' || osm_id || ' (' || CASE
      WHEN k % 2 = 0 THEN (k % 90)::VARCHAR || ' Main Street' ELSE 'no address' END || ', building=' || building_tag || '): floors ' || floors || ', height ' || printf('%.1f',
      height_m) || ' m' AS warning
  FROM d WHERE clamped
)
SELECT patch_id, nth::INT AS nth, osm_id, warning, total FROM texts WHERE nth <= 5""")


def a14_fallbacks_by_patch(spark, sf):
    return fo.fallback_counts(_full(spark, sf)).groupBy("patch_id").agg(F.sum("n").alias("n"))


add("a14_fallbacks_by_patch", a14_fallbacks_by_patch, CLASSES_SQL + "SELECT patch_id, count(*)::BIGINT AS n FROM d WHERE filter_reason = 'kept' AND roof_asked <> actual_roof GROUP BY ALL")
