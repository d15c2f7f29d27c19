"""Queries over walls and roofs, and their SQL.

A query over faces sums, for each building, its corners' coordinates and texture
coordinates and a mixed product of them; the SQL lists the same corners one by one,
so a wrong, swapped or missing corner shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions import kernels, roofs
from terralith.operators import footprints as fo
from terralith.operators import panels as pa
from terralith.plans.derived import FOOTPRINTS_SQL, patch_name, table
from terralith.plans.footprint_queries import CLASSES_SQL, _full
from terralith.shared import scratch, shared_folder, written

Q: dict = {}
O: dict = {}  # noqa: E741

#: b: buildings with their choices of texture and box; we: their wall edges.
WALLS_SQL = FOOTPRINTS_SQL + CLASSES_SQL + """
, b AS (
  SELECT d.*, mod(('0x' || right(sha256(seed || 'roof'), 8))::BIGINT & 2147483647, 6) AS slice,
    mod(('0x' || right(sha256(seed || 'facade'), 8))::BIGINT & 2147483647, 12) AS facade,
    mod(('0x' || right(sha256(seed || 'region'), 8))::BIGINT & 2147483647, 6) + CASE WHEN category = 'commercial' THEN 6 ELSE 0 END AS region,
    cos(radians(axis_deg)) AS co_a, sin(radians(axis_deg)) AS si_a, 100 + height_m AS top
  FROM d
), we AS (
  SELECT b.*, ring_no, pos, x, y, e.x2, e.y2, sqrt((e.x2 - x) ** 2 + (e.y2 - y) ** 2) AS len, 1 / 3::DOUBLE AS u0,
    1 / 3::DOUBLE + greatest(1, ceil(round(sqrt((e.x2 - x) ** 2 + (e.y2 - y) ** 2) / 3, 9))) / 3 AS u1
  FROM edges e JOIN b USING (osm_id)
)
"""
#: Sums of the corners fc (osm_id, face, x, y, z, u, v).
SUMS_SQL = f"""
SELECT osm_id, count(DISTINCT face) AS faces, round(sum(x), 3) + 0 AS x, round(sum(y), 3) + 0 AS y, round(sum(z), 3) + 0 AS z, round(sum(u), 6) + 0 AS u, round(sum(v), 6) + 0 AS v,
  round(sum(x * z + y * u + z * v) * {kernels.MIX}::DOUBLE, 2) + 0 AS mixed
FROM fc GROUP BY osm_id"""


def quad_sql(face: str, low: str, high: str, v0: str, v1: str, u0: str = "u0", u1: str = "u1") -> str:
    """The corners of a wall over an edge, in order."""
    return (
        f"SELECT osm_id, {face} AS face, unnest([x, x2, x2, x]) AS x, unnest([y, y2, y2, y]) AS y, unnest([{low}, {low}, {high}, {high}]) AS z, "
        f"unnest([{u0}, {u1}, {u1}, {u0}]) AS u, unnest([{v0}, {v0}, {v1}, {v1}]) AS v"
    )


def turned_sql(face: str, corners: list[tuple[str, str, str, str, str]]) -> str:
    """Corners given along and across the axis from the vertex mean, with z, u and v."""
    lists = [", ".join(f"({c[k]})::DOUBLE" for c in corners) for k in range(5)]
    inner = f"SELECT osm_id, {face} AS face, mx, my, co_a, si_a, " + ", ".join(f"unnest([{values}]) AS {name}" for values, name in zip(lists, ("pa", "pc", "z", "u", "v")))
    return f"SELECT osm_id, face, mx + pa * co_a - pc * si_a AS x, my + pa * si_a + pc * co_a AS y, z, u, v FROM ({inner} FROM r)"


def add(name: str, query, sql: str) -> None:
    Q[name] = query
    O[name] = f"WITH {WALLS_SQL}{sql}"


def built(spark, sf) -> DataFrame:
    return pa.textured(_full(spark, sf).withColumn("floor_z", F.lit(100.0)))


def summed(faces: DataFrame) -> DataFrame:
    each = faces.select("osm_id", kernels.corner_sums("corners").alias("c"))
    total = lambda name, digits: (F.round(F.sum(f"c.{name}"), digits) + F.lit(0.0)).alias(name)
    return each.groupBy("osm_id").agg(F.count("*").alias("faces"), *[total(n, 3) for n in "xyz"], *[total(n, 6) for n in "uv"], total("mixed", 2))


def g1_floor_panels(spark, sf):
    return summed(pa.floor_panels(built(spark, sf)))


_SECTION = "(0.75 - facade / 16::DOUBLE - (CASE floor WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) / 48::DOUBLE)"
add("g1_floor_panels", g1_floor_panels, f"""
, fl AS (SELECT *, height_m / floors AS step, unnest(range(floors)) AS floor FROM we), fc AS (
  {quad_sql("(ring_no * 1000 + pos) * 100 + floor", "100 + floor * step", "100 + floor * step + step", f"({_SECTION} - 1 / 48::DOUBLE) / 0.75", f"{_SECTION} / 0.75")} FROM fl
) {SUMS_SQL}""")


def g2_highrise_panels(spark, sf):
    return summed(pa.highrise_panels(built(spark, sf).where("wall_kind = 'highrise'")))


_REGION_LOW = "(1 - (region + 1) / 12::DOUBLE + CASE WHEN part = 0 THEN 0 ELSE 1 / 48::DOUBLE END)"
add("g2_highrise_panels", g2_highrise_panels, f"""
, ps AS (SELECT *, unnest(range(1 + greatest(0, ceil((floors - 4) / 3::DOUBLE))::INT)) AS part FROM we WHERE wall_kind = 'highrise'
), fl AS (
  SELECT *, height_m / floors AS step, CASE WHEN part = 0 THEN 0 ELSE 4 + (part - 1) * 3 END AS below, least(floors, 4 + part * 3) AS above, 0::DOUBLE AS w0, greatest(1, ceil(round(len / 3, 9))) / 8 AS w1 FROM ps
), fc AS (
  {quad_sql("(ring_no * 1000 + pos) * 100 + part", "100 + below * step", "100 + above * step", _REGION_LOW, f"{_REGION_LOW} + (above - below) / 48::DOUBLE", "w0", "w1")} FROM fl
) {SUMS_SQL}""")


def g3_side_walls(spark, sf):
    return summed(pa.side_walls(built(spark, sf)))


_GROUND, _SIDE_TOP = "(0.75 - facade / 16::DOUBLE - 3 / 48::DOUBLE)", "(0.75 - facade / 16::DOUBLE - (CASE WHEN floors = 1 THEN 2 ELSE 1 END) / 48::DOUBLE)"
SIDES_SQL = quad_sql("ring_no * 1000 + pos", "100", "top", _GROUND, _SIDE_TOP)
add("g3_side_walls", g3_side_walls, f", fc AS ({SIDES_SQL} FROM we) {SUMS_SQL}")


def g4_gable_walls(spark, sf):
    return summed(pa.gable_walls(built(spark, sf).where("actual_roof = 'gabled'")))


_GABLE_LOW, _GABLE_HIGH = "(0.75 - facade / 16::DOUBLE - 1 / 48::DOUBLE)", "(0.75 - facade / 16::DOUBLE)"
GABLES_SQL = f"""
, al AS (SELECT *, abs((x2 - x) * co_a + (y2 - y) * si_a) / len < 0.3 AS ends FROM we WHERE actual_roof = 'gabled'), gw AS (
  {SIDES_SQL} FROM al
  UNION ALL SELECT osm_id, ring_no * 1000 + pos + 500, unnest([x, x2, (x + x2) / 2]), unnest([y, y2, (y + y2) / 2]), unnest([top, top, top + 3]), unnest([u0, u1, (u0 + u1) / 2]),
    unnest([{_GABLE_LOW}, {_GABLE_LOW}, {_GABLE_HIGH}]) FROM al WHERE ends AND floors = 1
  UNION ALL SELECT osm_id, ring_no * 1000 + pos, (x + x2) / 2, (y + y2) / 2, top + 3, (u0 + u1) / 2, {_GABLE_HIGH} FROM al WHERE ends AND floors > 1
)"""
add("g4_gable_walls", g4_gable_walls, f"{GABLES_SQL}, fc AS (FROM gw) {SUMS_SQL}")


def g5_gabled_roofs(spark, sf):
    return summed(pa.gabled_roofs(built(spark, sf).where("actual_roof = 'gabled'")))


def _slope_sql(side: str) -> str:
    l, w = f"{side}hl", f"-({side}reach)"
    return turned_sql(f"CASE WHEN '{side}' = '' THEN 1 ELSE 2 END",
        [(f"-({l})", w, "eave", "0", "v0"), (l, w, "eave", "2 * hl / reach", "v0"), (l, "0", "ridge", "2 * hl / reach", "v1"), (f"-({l})", "0", "ridge", "0", "v1")])


GABLED_SQL = f"""
, r AS (
  SELECT *, ol / 2 + 0.5 AS hl, ow / 2 + 0.5 AS reach, top + 3 AS ridge, top + 3 - 3 / (ow / 2) * (ow / 2 + 0.5) AS eave, 1 - (slice + 1) / 24::DOUBLE AS v0, 1 - slice / 24::DOUBLE AS v1
  FROM b WHERE actual_roof = 'gabled'
), gr AS ({_slope_sql("")} UNION ALL {_slope_sql("-")})"""
add("g5_gabled_roofs", g5_gabled_roofs, f"{GABLED_SQL}, fc AS (FROM gr) {SUMS_SQL}")


def g6_hipped_roofs(spark, sf):
    roof = pa.hipped_roofs(built(spark, sf).where("actual_roof = 'hipped'"))
    return summed(roof).join(roof.select("osm_id", "pyramid").distinct(), "osm_id")


def _hip_sql(end: str) -> str:
    """A hip over the short edge on one end, and the slope that follows it."""
    l, w, rl = f"{end}hl", f"{end}hw", f"{end}(hl - hw)"
    hip = [(l, f"-({w})", "eave", "0", "v0"), (l, w, "eave", "2", "v0"), (rl, "0", "peak", "1", "v1")]
    slope = [(l, w, "eave", "0", "v0"), (f"-({l})", w, "eave", "2 * hl / hw", "v0"), (f"-({rl})", "0", "peak", "hl / hw", "v1"), (rl, "0", "peak", "hl / hw", "v1")]
    which = "1" if end == "" else "2"
    return " UNION ALL ".join(f"SELECT * FROM ({turned_sql(face, corners)}) WHERE osm_id IN (SELECT osm_id FROM r WHERE NOT pyramid)" for face, corners in ((which, hip), (f"{which} + 2", slope)))


def _pyramid_sql() -> str:
    corners = [("hl", "-hw"), ("hl", "hw"), ("-hl", "hw"), ("-hl", "-hw")]
    faces = []
    for k, (p, q) in enumerate(zip(corners, corners[1:] + corners[:1])):
        span = "2 * hw / hl" if k % 2 == 0 else "2 * hl / hw"
        faces.append(f"SELECT * FROM ({turned_sql(str(k), [(*p, 'eave', '0', 'v0'), (*q, 'eave', span, 'v0'), ('0', '0', 'top + 3', f'({span}) / 2', 'v1')])}) WHERE osm_id IN (SELECT osm_id FROM r WHERE pyramid)")
    return " UNION ALL ".join(faces)


#: Eligible footprints of four vertices are rectangles here, so distances are half the sides.
HIPPED_SQL = f"""
, r0 AS (SELECT *, (ol - ow) / ol < 0.15 AS pyramid, 3 / (ol / 2) AS pitch, ol / 2 + 0.5 AS hl, ow / 2 + 0.5 AS hw, 1 - (slice + 1) / 24::DOUBLE AS v0, 1 - slice / 24::DOUBLE AS v1 FROM b WHERE actual_roof = 'hipped'
), r AS (SELECT *, top - pitch * 0.5 AS eave, top - pitch * 0.5 + hw * pitch AS peak FROM r0
), hr AS ({_hip_sql("")} UNION ALL {_hip_sql("-")} UNION ALL {_pyramid_sql()})"""
add("g6_hipped_roofs", g6_hipped_roofs, f"{HIPPED_SQL}, fc AS (FROM hr), s AS ({SUMS_SQL}) SELECT s.*, pyramid FROM s JOIN r USING (osm_id)")


def g7_flat_fans(spark, sf):
    return summed(pa.flat_fans(built(spark, sf)))


def _metres_sql(x: str, y: str) -> tuple[str, str]:
    return f"(({x}) - mx) * co_a + (({y}) - my) * si_a", f"-(({x}) - mx) * si_a + (({y}) - my) * co_a"


_FIRST, _SECOND = _metres_sql("x", "y"), _metres_sql("x2", "y2")
add("g7_flat_fans", g7_flat_fans, f"""
, fc AS (
  SELECT osm_id, pos AS face, unnest([mx, x, x2]) AS x, unnest([my, y, y2]) AS y, unnest([top, top, top]) AS z, unnest([0, {_FIRST[0]}, {_SECOND[0]}]) AS u, unnest([0, {_FIRST[1]}, {_SECOND[1]}]) AS v
  FROM we WHERE convex AND NOT has_hole AND ring_no = 0
) {SUMS_SQL}""")


def g7_flat_polygons(spark, sf):
    return summed(pa.flat_polygons(built(spark, sf).where("actual_roof = 'flat'")))


FLAT_SQL = f", fr AS (SELECT osm_id, ring_no AS face, x, y, top AS z, {_FIRST[0]} AS u, {_FIRST[1]} AS v FROM we WHERE actual_roof = 'flat')"
add("g7_flat_polygons", g7_flat_polygons, f"{FLAT_SQL}, fc AS (FROM fr) {SUMS_SQL}")


def g8_shared_vertices(spark, sf):
    found = pa.indexed_corners(pa.floor_panels(built(spark, sf)), ["patch_id", "osm_id"], ["osm_id", "ring_no", "pos", "part"], together=True)
    held = F.col("corner").isNotNull()
    return found.groupBy("osm_id").agg(F.count_if("own").alias("vertices"), F.count_if(held).alias("corners"), F.sum(F.when(held, F.col("vertex_id"))).alias("sum_of_ids"))


add("g8_shared_vertices", g8_shared_vertices, """
, fl AS (SELECT osm_id, ring_no, pos, floors, height_m / floors AS step, unnest(range(floors)) AS floor, x, y, x2, y2 FROM we
), cs AS (
  SELECT osm_id, ring_no, pos, floor, unnest([x, x2, x2, x]) AS x, unnest([y, y2, y2, y]) AS y, unnest([100 + floor * step, 100 + floor * step,
    100 + floor * step + step, 100 + floor * step + step]) AS z FROM fl
), rd AS (SELECT osm_id, ring_no, pos, floor, round_even(x, 4) + 0 AS x, round_even(y, 4) + 0 AS y, round_even(z, 4) + 0 AS z FROM cs
), vs AS (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY x, y, z) AS vertex_id FROM (SELECT DISTINCT osm_id, x, y, z FROM rd)
), fs AS (SELECT osm_id, ring_no, pos, floor, x, y, z FROM (SELECT DISTINCT * FROM rd) QUALIFY count(*) OVER (PARTITION BY osm_id, ring_no, pos, floor) >= 3)
SELECT osm_id, (SELECT count(*) FROM vs WHERE vs.osm_id = fs.osm_id) AS vertices, count(*) AS corners, sum(vertex_id)::BIGINT AS sum_of_ids FROM fs JOIN vs USING (osm_id, x, y, z) GROUP BY osm_id""")


def g9_outward(spark, sf):
    buildings = built(spark, sf)
    own = buildings.withColumns({"own_outer": F.col("outer"), "own_holes": F.col("holes")})
    turned = own.withColumn("outer", F.when(F.col("k") % 2 == 0, F.col("outer")).otherwise(F.reverse("outer")))
    return pa.outward(pa.side_walls(turned, [*pa.KEY, "own_outer", "own_holes"]), buildings).groupBy("osm_id").agg(F.count_if("reversed").alias("reversed"), F.count("*").alias("faces"))


add("g9_outward", g9_outward, "SELECT osm_id, count(*) FILTER (ring_no = 0 AND osm_id::BIGINT % 2 = 1) AS reversed, count(*) AS faces FROM we GROUP BY osm_id")


def g10_triangles(spark, sf):
    return summed(pa.side_walls(built(spark, sf)).select("osm_id", F.explode(pa.fan(F.col("corners"))).alias("corners")))


add("g10_triangles", g10_triangles, f"""
, fc AS (
  SELECT osm_id, (ring_no * 1000 + pos) * 2 + half AS face, unnest(CASE half WHEN 0 THEN [x, x2, x2] ELSE [x, x2, x] END) AS x, unnest(CASE half WHEN 0 THEN [y, y2, y2] ELSE [y, y2, y] END) AS y,
    unnest(CASE half WHEN 0 THEN [100, 100, top] ELSE [100, top, top] END) AS z, unnest(CASE half WHEN 0 THEN [u0, u1, u1] ELSE [u0, u1, u0] END) AS u,
    unnest(CASE half WHEN 0 THEN [{_GROUND}, {_GROUND}, {_SIDE_TOP}] ELSE [{_GROUND}, {_SIDE_TOP}, {_SIDE_TOP}] END) AS v
  FROM we, range(2) t(half)
) {SUMS_SQL}""")


def e4_double_sided(spark, sf):
    return pa.both_sides(pa.gabled_roofs(built(spark, sf).where("actual_roof = 'gabled'"))).groupBy("back").agg(F.count("*").alias("faces"))


add("e4_double_sided", e4_double_sided, "SELECT unnest([TRUE, FALSE]) AS back, 2 * count(*) AS faces FROM b WHERE actual_roof = 'gabled'")


def e4_one_sided(spark, sf):
    roofs_ = pa.both_sides(pa.gabled_roofs(built(spark, sf).where("actual_roof = 'gabled'")))
    return pa.one_side(roofs_).groupBy("osm_id").agg(F.count("*").alias("faces"))


add("e4_one_sided", e4_one_sided, "SELECT osm_id, 2::BIGINT AS faces FROM b WHERE actual_roof = 'gabled'")


#: What walls and roofs are made from.
FACE_COLUMNS = ["actual_roof", "outer", "holes", "floor_z", "height_m", "floors", "facade", "roof_slice", "axis_deg", "obb", "centroid"]


def all_faces(whole: DataFrame) -> DataFrame:
    """Walls and roofs of buildings with their group: pitched roofs apart from the houses."""
    wall, roof = fo.mesh_group(F.col("wall_kind"), F.col("actual_roof"), roofs.flat_bucket(F.col("seed")), folded=False)
    # Six kinds of faces come from the same classified buildings.
    buildings = written(whole.select("patch_id", "osm_id", wall.alias("wall_group"), roof.alias("roof_group"), *FACE_COLUMNS), "built")
    walls_key, roofs_key = [*pa.KEY, "wall_group"], [*pa.KEY, "roof_group"]
    plain = lambda faces, part: faces.select("patch_id", "osm_id", F.lit(part).alias("ring_no"), *([c for c in ("pos", "part") if c in faces.columns]), "corners", faces[walls_key[-1] if part == 0 else roofs_key[-1]].alias("grp"))
    walls = plain(pa.side_walls(buildings.where("actual_roof <> 'gabled'"), walls_key), 0).unionByName(plain(pa.gable_walls(buildings.where("actual_roof = 'gabled'"), walls_key), 0))
    tops = pa.gabled_roofs(buildings.where("actual_roof = 'gabled'"), key=roofs_key).unionByName(pa.hipped_roofs(buildings.where("actual_roof = 'hipped'"), key=roofs_key).drop("pyramid"))
    # A flat roof's rings are faces next to each other, the outer one first, then its holes.
    flat = pa.flat_polygons(buildings.where("actual_roof = 'flat'"), roofs_key).withColumn("part", F.lit(0)).withColumnRenamed("ring_no", "pos")
    tops = plain(tops.withColumn("pos", F.lit(0)).unionByName(flat), 1)
    return walls.unionByName(tops).withColumn("lod", F.lit(0))


def exported(buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group meshes with shared vertices, pitched roofs merged into the houses, numbered in export order."""
    group, face = ["patch_id", "lod", "grp"], ["osm_id", "ring_no", "pos", "part"]
    vertices, corners = pa.shared_vertices(all_faces(buildings), group, face)
    merged = F.when(F.col("grp").isin("gabled_roofs_lod0", "hipped_roofs"), "houses").otherwise(F.col("grp"))
    place = F.when(F.col("grp") == "gabled_roofs_lod0", 1).when(F.col("grp") == "hipped_roofs", 2).otherwise(0)
    return pa.numbered_for_export(*pa.merged_groups(vertices, corners, merged, place))


#: Buildings of the patches that are exported at once, where single patches don't have more.
SHARE = 1_000_000


def patch_shares(buildings: DataFrame, most: int = SHARE) -> list[list[str]]:
    """The patches in order, as many at once as have ``most`` buildings together: at least one patch, however large."""
    shares, held = [], 0
    for r in buildings.groupBy("patch_id").count().orderBy("patch_id").collect():
        if not shares or held + r["count"] > most:
            shares.append([])
            held = 0
        shares[-1].append(r.patch_id)
        held += r["count"]
    return shares


def e3_k2_merged_export(spark, sf):
    """Patches have numbers of their own, so they are exported share by share, and a share's faces, corners and shuffles are gone before the next."""
    path = shared_folder(spark, "export")
    patches = table(spark, sf, "orders").select(patch_name(F.col("o_custkey") % 25).alias("patch_id"))
    for share in patch_shares(patches) or [[]]:
        with scratch(spark):
            vertices, corners = exported(built(spark, sf).where(F.col("patch_id").isin(share)))
            of_vertices = vertices.groupBy("patch_id", "grp").agg(F.count("*").alias("vertices"), F.min("index").cast("bigint").alias("first_index"), F.max("index").cast("bigint").alias("last_index"))
            of_corners = corners.groupBy("patch_id", "grp").agg(
                F.count("*").alias("corners"), F.sum("index").cast("bigint").alias("sum_of_indices"), F.min("uv_index").cast("bigint").alias("first_uv"), F.max("uv_index").cast("bigint").alias("last_uv")
            )
            found = of_vertices.join(of_corners, ["patch_id", "grp"])
            found.write.mode("append").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


EXPORT_SQL = f"""
{GABLES_SQL}{GABLED_SQL}{HIPPED_SQL.replace(", r0 AS", ", h0 AS").replace(", r AS (SELECT *, top - pitch", ", h AS (SELECT *, top - pitch").replace("FROM r0", "FROM h0").replace("FROM r)", "FROM h)").replace("FROM r WHERE", "FROM h WHERE")}{FLAT_SQL}
, sw AS ({SIDES_SQL} FROM we WHERE actual_roof <> 'gabled'
), every AS (
  SELECT osm_id, 0 AS ring, face, x, y, z, 'wall' AS what FROM sw UNION ALL SELECT osm_id, 0, face, x, y, z, 'wall' FROM gw
  UNION ALL SELECT osm_id, 1, face, x, y, z, 'roof' FROM gr UNION ALL SELECT osm_id, 1, face, x, y, z, 'roof' FROM hr UNION ALL SELECT osm_id, 1, face, x, y, z, 'roof' FROM fr
), grouped AS (
  SELECT b.patch_id, osm_id, ring, face, round_even(x, 4) + 0 AS x, round_even(y, 4) + 0 AS y, round_even(z, 4) + 0 AS z,
    CASE WHEN what = 'wall' THEN CASE WHEN actual_roof <> 'flat' THEN 'houses' WHEN wall_kind = 'highrise' THEN 'Highrise_walls' ELSE 'industrial_walls' END
      ELSE CASE actual_roof WHEN 'gabled' THEN 'gabled_roofs_lod0' WHEN 'hipped' THEN 'hipped_roofs' ELSE 'flat_roof_' || (seed % 6 + 1) END END AS grp
  FROM every JOIN b USING (osm_id)
), vs AS (
  SELECT *, row_number() OVER (PARTITION BY patch_id, grp ORDER BY x, y, z) AS vertex_id FROM (SELECT DISTINCT patch_id, grp, x, y, z FROM grouped)
), n AS (
  SELECT patch_id, grp, count(*) AS n, CASE WHEN grp IN ('gabled_roofs_lod0', 'hipped_roofs') THEN 'houses' ELSE grp END AS into_, CASE grp WHEN 'gabled_roofs_lod0' THEN 1 WHEN 'hipped_roofs' THEN 2 ELSE 0 END AS place FROM vs GROUP BY patch_id, grp
), base_of AS (SELECT patch_id, grp, into_, coalesce(sum(n) OVER (PARTITION BY patch_id ORDER BY into_, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n
), vi AS (SELECT patch_id, grp, into_, x, y, z, before + vertex_id AS index FROM vs JOIN base_of USING (patch_id, grp)
), fs AS (SELECT * FROM (SELECT DISTINCT * FROM grouped) QUALIFY count(*) OVER (PARTITION BY patch_id, osm_id, ring, face) >= 3
), fi AS (SELECT patch_id, into_, index FROM fs JOIN vi USING (patch_id, grp, x, y, z)
), cn AS (SELECT patch_id, into_, count(*) AS corners, sum(index)::BIGINT AS sum_of_indices FROM fi GROUP BY ALL
), cu AS (SELECT *, coalesce(sum(corners) OVER (PARTITION BY patch_id ORDER BY into_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM cn)
"""
add("e3_k2_merged_export", e3_k2_merged_export, EXPORT_SQL + """
SELECT v.patch_id, v.into_ AS grp, count(*) AS vertices, min(index)::BIGINT AS first_index, max(index)::BIGINT AS last_index, any_value(corners) AS corners,
  any_value(sum_of_indices) AS sum_of_indices, any_value(before) + 1 AS first_uv, any_value(before) + any_value(corners) AS last_uv
FROM vi v JOIN cu USING (patch_id, into_) GROUP BY ALL""")


def k2_w14_w15_export_offsets(spark, sf):
    """Numbers of groups of all kinds, in the order that the export wants."""
    kinds = F.when(F.col("actual_roof") == "flat", F.col("wall_kind")).when(F.col("k") % 3 == 0, "wind_turbine_2").when(F.col("k") % 3 == 1, "transmitter").otherwise("pylones")
    return pa.export_offsets(pa.lods(built(spark, sf)).groupBy("patch_id", "lod", kinds.alias("grp")).agg(F.count("*").alias("n")))


add("k2_w14_w15_export_offsets", k2_w14_w15_export_offsets, """
, g AS (
  SELECT patch_id, lod, CASE WHEN actual_roof = 'flat' THEN wall_kind WHEN k % 3 = 0 THEN 'wind_turbine_2' WHEN k % 3 = 1 THEN 'transmitter' ELSE 'pylones' END AS grp,
    count(*) AS n FROM b, (VALUES (0), (1)) l(lod) GROUP BY ALL
)
SELECT *, coalesce(sum(n) OVER (
  PARTITION BY patch_id, lod ORDER BY CASE grp WHEN 'wind_turbine_2' THEN 1 WHEN 'transmitter' THEN 2 WHEN 'pylones' THEN 3 ELSE 0 END, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
), 0)::BIGINT + 1 AS first FROM g""")


def a24_mesh_quality(spark, sf):
    """Walls of which every seventh building's lose two corners, every fifth's repeat one and every third's have no texture."""
    walls = pa.side_walls(built(spark, sf))
    k = F.col("osm_id").cast("bigint")
    broken = F.when(k % 7 == 0, F.slice("corners", 1, 2)).when(k % 5 == 0, F.concat(F.slice("corners", 1, 3), F.slice("corners", 1, 1))).otherwise(F.col("corners"))
    bare = F.transform(broken, lambda p: p.withField("u", F.when(k % 3 != 0, p["u"])))
    return pa.quality(walls.withColumn("corners", bare))


add("a24_mesh_quality", a24_mesh_quality, """
SELECT patch_id, count(*) AS faces, count_if(k % 7 = 0)::BIGINT AS too_few, count_if(k % 5 = 0 AND k % 7 <> 0)::BIGINT AS repeated_corner,
  count_if(k % 3 = 0)::BIGINT AS untextured FROM we GROUP BY patch_id""")


def a24_bad_indices(spark, sf):
    """Corners whose vertices, those of every ninth building, were taken away."""
    faces = pa.side_walls(built(spark, sf)).withColumn("grp", F.lit("walls"))
    vertices, corners = pa.shared_vertices(faces, ["patch_id", "osm_id"], ["osm_id", "ring_no", "pos", "part"])
    return pa.bad_indices(corners, vertices.where("osm_id % 9 <> 0 OR vertex_id > 2"), ["patch_id", "osm_id"]).select("osm_id", "n")


add("a24_bad_indices", a24_bad_indices, """
, cs AS (SELECT osm_id, ring_no, pos, round_even(unnest([x, x2, x2, x]), 4) + 0 AS x, round_even(unnest([y, y2, y2, y]), 4) + 0 AS y, round_even(unnest([100, 100, top, top]), 4) + 0 AS z FROM we
), vs AS (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY x, y, z) AS vertex_id FROM (SELECT DISTINCT osm_id, x, y, z FROM cs)
), fs AS (SELECT * FROM (SELECT DISTINCT * FROM cs) QUALIFY count(*) OVER (PARTITION BY osm_id, ring_no, pos) >= 3)
SELECT osm_id, count(*) AS n FROM fs JOIN vs USING (osm_id, x, y, z) WHERE osm_id::BIGINT % 9 = 0 AND vertex_id <= 2 GROUP BY osm_id""")


def a23_mesh_bounds(spark, sf):
    bound = lambda pick, axis: F.round(pick(F.transform("corners", lambda p: p[axis])), 4)
    faces = pa.side_walls(built(spark, sf))
    return faces.groupBy("patch_id").agg(*[F.min(bound(F.array_min, a)).alias(f"min_{a}") for a in "xyz"], *[F.max(bound(F.array_max, a)).alias(f"max_{a}") for a in "xyz"])


add("a23_mesh_bounds", a23_mesh_bounds, """
SELECT patch_id, round(min(x), 4) AS min_x, round(min(y), 4) AS min_y, 100::DOUBLE AS min_z, round(max(x), 4) AS max_x, round(max(y), 4) AS max_y, round(max(top),
  4) AS max_z FROM we GROUP BY patch_id""")


def g17_lods(spark, sf):
    return pa.lods(built(spark, sf)).groupBy("lod", "overhang").agg(F.count("*").alias("n"))


add("g17_lods", g17_lods, "SELECT lod, CASE lod WHEN 0 THEN 0.5 ELSE 0 END::DOUBLE AS overhang, count(*) AS n FROM b, (VALUES (0), (1)) l(lod) GROUP BY ALL")


def k5_axis_transform(spark, sf):
    return summed(pa.exported(pa.side_walls(built(spark, sf))))


add("k5_axis_transform", k5_axis_transform, f", fc0 AS ({SIDES_SQL} FROM we), fc AS (SELECT osm_id, face, y AS x, -x AS y, z, u, v FROM fc0) {SUMS_SQL}")


def p21_textures(spark, sf):
    """The texture of each group that the buildings make, and of a few others; merged flat roofs take the photo of their patch."""
    wall, roof = fo.mesh_group(F.col("wall_kind"), F.col("actual_roof"), roofs.flat_bucket(F.col("seed")), F.col("wall_kind") == "plain")
    groups = built(spark, sf).select("patch_id", F.explode(F.array(wall, roof, F.lit("aerialway"), F.lit("chimney"))).alias("grp"))
    found = groups.groupBy("patch_id", "grp").agg(F.count("*").alias("n"))
    return found.select("patch_id", "grp", "n", pa.texture_for(F.col("grp"), F.col("patch_id"), True).alias("t")).select("patch_id", "grp", "n", "t.material", "t.texture")


add("p21_textures", p21_textures, """
, g AS (
  SELECT patch_id, unnest([CASE WHEN actual_roof <> 'flat' THEN 'houses' WHEN wall_kind = 'highrise' THEN 'Highrise_walls' ELSE 'industrial_walls' END,
    CASE WHEN actual_roof <> 'flat' THEN 'houses' WHEN wall_kind = 'plain' THEN 'flat_roof' ELSE 'flat_roof_' || (seed % 6 + 1) END, 'aerialway', 'chimney']) AS grp FROM b
)
SELECT patch_id, grp, count(*) AS n, CASE grp WHEN 'aerialway' THEN 'pylones' ELSE grp END AS material, CASE grp WHEN 'houses' THEN 'Houses_Atlas.dds' WHEN 'Highrise_walls' THEN 'Highrise_Atlas.dds'
  WHEN 'industrial_walls' THEN 'Industrial_Atlas.dds' WHEN 'flat_roof' THEN 't' || patch_id || '.dds' WHEN 'aerialway' THEN 'Pylons.dds'
    WHEN 'chimney' THEN 'Chimney.dds' ELSE 'Roof' || right(grp, 1) || '.dds' END AS texture
FROM g GROUP BY patch_id, grp""")
