"""Queries that write derived tables in the formats of the readers, read them back and compare with the tables' SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators import footprints as fo
from terralith.operators import panels as pa
from terralith.plans import place_queries as pl
from terralith.plans.derived import FOOTPRINTS_SQL, footprints, patch_name, table
from terralith.plans.element_queries import ELEMENTS_SQL, elements
from terralith.plans.footprint_queries import CLASSES_SQL, _full
from terralith.plans.panel_queries import WALLS_SQL, built
from terralith.sources import readers, sinks
from terralith.streaming.increments import process_new_patches

Q: dict = {}
O: dict = {}  # noqa: E741


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or on this machine where a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def add(name: str, query, sql: str) -> None:
    Q[name] = query
    O[name] = f"WITH {sql.strip()}"


def by_patch(lines: DataFrame, path: str, order: list[str]) -> str:
    """Text files, one for each patch, of lines (patch_id, value) in order."""
    lines.repartition("patch_id").sortWithinPartitions("patch_id", *order).select("patch_id", "value").write.partitionBy("patch_id").text(path)
    return path


#: Lines of one file of an extract, and files of one patch at most: an XML file is one task's work.
FILE_LINES, MOST_FILES = 500_000, 32


def by_extract(lines: DataFrame, path: str, file_lines: int = FILE_LINES) -> str:
    """Map extracts of elements (patch_id, value, kind): as many files for each patch as its size wants, each with a root element of its own."""
    spark, first, rows = lines.sparkSession, 0, []
    for r in lines.groupBy("patch_id").count().orderBy("patch_id").collect():
        files = min(MOST_FILES, -(-r["count"] // file_lines))
        rows.append((r.patch_id, first, files))
        first += files
    patches = F.broadcast(spark.createDataFrame(rows, "patch_id string, first int, files int"))
    dealt = lines.join(patches, "patch_id").select("patch_id", "value", "kind", (F.col("first") + F.pmod(F.xxhash64("value"), "files")).cast("int").alias("file"))
    ends = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(k).alias("kind")) for v, k in (("<osm>", -1), ("</osm>", 9))])
    roots = patches.select("patch_id", F.explode(F.sequence("first", F.col("first") + F.col("files") - 1)).alias("file")).select("patch_id", "file", F.inline(ends))
    placed = dealt.unionByName(roots).repartitionById(max(1, first), "file").sortWithinPartitions("patch_id", "kind", "value")
    placed.select("patch_id", "value").write.partitionBy("patch_id").text(path)
    return path


def _line(pattern: str, *values) -> F.Column:
    """``pattern`` with values in place of each %s, as format_string has it; nulls are empty."""
    texts = [F.lit(t) for t in pattern.split("%s")]
    return F.concat_ws("", texts[0], *[c for pair in zip(values, texts[1:]) for c in pair])


def _tag_lines(tags) -> F.Column:
    return F.array_join(F.transform(F.map_entries(tags), lambda t: _line('<tag k="%s" v="%s"/>', t["key"], t["value"])), "")


def element_lines(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(patch_id, value, kind): elements as lines of a map extract."""
    node = nodes.select("patch_id", _line('<node id="%s" lat="%s" lon="%s"/>', F.col("node_id"), F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value"), F.lit(0).alias("kind"))
    refs = F.array_join(F.transform("refs", lambda r: _line('<nd ref="%s"/>', r)), "")
    way = ways.select("patch_id", _line('<way id="%s">%s%s</way>', F.col("way_id"), refs, _tag_lines(F.col("tags"))).alias("value"), F.lit(1).alias("kind"))
    members = F.array_join(F.transform("members", lambda m: _line('<member type="%s" ref="%s" role="%s"/>', m["type"], m["ref"], m["role"])), "")
    relation = relations.select("patch_id", _line('<relation id="%s">%s%s</relation>', F.col("rel_id"), members, _tag_lines(F.col("tags"))).alias("value"), F.lit(2).alias("kind"))
    return node.unionByName(way).unionByName(relation)


def s1_map_elements(spark, sf):
    """Nodes, ways and relations of each patch as a map extract."""
    path = by_extract(element_lines(*elements(spark, sf)), folder(spark, "map"))
    n, w, r = readers.read_map_elements(spark, path + "/*/*")
    counts = lambda df, kind, size, total: df.groupBy("patch_id").agg(F.count("*").alias("n"), F.sum(size).cast("bigint").alias("parts"),
        F.round(F.sum(total), 3).alias("total")).withColumn("kind", F.lit(kind))
    zero = F.lit(0.0)
    tagged = F.size("tags")
    return counts(n, "node", tagged, F.col("lat") + F.col("lon")).unionByName(counts(w, "way", F.size("refs") + tagged, zero)).unionByName(counts(r, "relation", F.size("members") + tagged, zero))


add("s1_map_elements", s1_map_elements, ELEMENTS_SQL + """
, wy AS (
  SELECT patch_id, osm_id, ring_no, count(*) AS refs FROM rf GROUP BY ALL
), wn AS (
  SELECT w.patch_id, CASE WHEN w.ring_no = 0 AND has_hole THEN 2 ELSE 1 END AS ways, refs + CASE WHEN w.ring_no = 0 AND has_hole THEN 1 ELSE 0 END AS refs,
    CASE WHEN w.ring_no = 0 AND NOT has_hole THEN 1 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END ELSE 0 END AS tags FROM wy w JOIN fp USING (osm_id)
)
SELECT patch_id, 'node' AS kind, count(*) AS n, 0::BIGINT AS parts, round(sum(lat + lon), 3) AS total FROM nd GROUP BY patch_id
UNION ALL SELECT patch_id, 'way', sum(ways)::BIGINT, sum(refs + tags)::BIGINT, 0 FROM wn GROUP BY patch_id
UNION ALL SELECT patch_id, 'relation', count(*), 5 * count(*), 0 FROM fp WHERE has_hole GROUP BY patch_id""")


def s2_patch_metadata(spark, sf):
    """A file of key: value lines for each patch; every seventh lacks a field."""
    number = F.col("patch_id").cast("int")
    rows = table(spark, sf, "orders").select(patch_name(F.col("o_custkey") % 25).alias("patch_id")).distinct()
    pairs = {"ZoneNumber": F.lit(33), "translate_x": -500000 - number, "TranslateY": -5000000 + number, "lat_min": F.lit(45.0),
        "latMax": 45.0 + number % 10 / 10.0 + 0.1, "lon_min": F.lit(15.0), "lon_max": F.when(number % 7 != 0, F.lit(15.5))}
    lines = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("v")) for k, v in pairs.items()])
    each = rows.select("patch_id", F.inline(lines)).where("v IS NOT NULL").select("patch_id", F.concat("key", F.lit(": "), "v").alias("value"))
    found = readers.read_patch_metadata(spark, by_patch(each, folder(spark, "metadata"), ["value"]) + "/*/*")
    return found.select("patch_id", "zone_number", "translate_x", "translate_y", F.round("lat_max", 6).alias("lat_max"), "lon_max", F.array_join("errors", ",").alias("errors"))


add("s2_patch_metadata", s2_patch_metadata, """
p AS (SELECT DISTINCT printf('%03d%03d', (o_custkey % 25) % 5, (o_custkey % 25) // 5) AS patch_id FROM orders), n AS (SELECT *, patch_id::INT AS number FROM p)
SELECT patch_id, 33 AS zone_number, -500000::DOUBLE - number AS translate_x, -5000000::DOUBLE + number AS translate_y, round(45 + number % 10 / 10::DOUBLE + 0.1, 6) AS lat_max,
  CASE WHEN number % 7 <> 0 THEN 15.5::DOUBLE END AS lon_max, CASE WHEN number % 7 = 0 THEN 'lon_max' ELSE '' END AS errors FROM n""")


def s3_terrain(spark, sf):
    """The terrain of all patches as vertex and face lines, a quad a face."""
    half = pl.triangles(spark, sf)
    number = F.col("tri").cast("bigint")
    corners = half.where("tri % 2 = 0").select("patch_id", number.alias("tri"), *[f"{a}{k}" for k in (1, 2, 3) for a in "xyz"]).join(half.where("tri % 2 = 1")
        .select("patch_id", (number - 1).alias("tri"), F.col("x3").alias("x4"), F.col("y3").alias("y4"), F.col("z3").alias("z4")), ["patch_id", "tri"])
    vertex = lambda k: F.struct((F.col("tri") * 2 + k).alias("nth"), F.concat_ws(" ", F.lit("v"), *[F.col(f"{a}{k}").cast("string") for a in "xyz"]).alias("value"))
    vertices = corners.select("patch_id", F.inline(F.array(*[vertex(k) for k in (1, 2, 3, 4)])))
    first = F.col("tri") * 2 + 1
    faces = corners.select("patch_id", (F.lit(10**9) + F.col("tri")).alias("nth"), F.concat_ws(" ", F.lit("f"), *[(first + k).cast("string") for k in range(4)]).alias("value"))
    found = readers.read_terrain(spark, by_patch(vertices.unionByName(faces), folder(spark, "terrain"), ["nth"]) + "/*/*")
    return found.groupBy("patch_id").agg(F.count("*").alias("triangles"), F.round(F.sum(F.col("z1") + F.col("z2") * 2 + F.col("z3") * 3), 2).alias("z"),
        F.round(F.sum(F.col("x1") * F.col("y3")), 1).alias("xy"))


add("s3_terrain", s3_terrain, pl.TERRAIN_SQL + """,
g AS (SELECT *, -2880 + 120::DOUBLE * i AS x, -2880 + 120::DOUBLE * j AS y FROM qd)
SELECT patch_id, 2 * count(*) AS triangles, round(sum(za + 2 * zb + 3 * zc + za + 2 * zc + 3 * zd), 2) AS z, round(sum(x * (y + 120) + x * (y + 120)), 1) AS xy FROM g GROUP BY patch_id""")


def s4_ml_footprints(spark, sf):
    """Footprints as lines of GeoJSON, rings closed; every eleventh is a point."""
    ring = F.transform(F.concat("outer", F.slice("outer", 1, 1)), lambda p: F.array(p["x"], p["y"]))
    kind = F.when(F.col("k") % 11 == 0, "Point").otherwise("Polygon")
    path = folder(spark, "footprints")
    footprints(spark, sf).select(F.struct(kind.alias("type"), F.array(ring).alias("coordinates")).alias("geometry")).write.json(path)
    found = readers.read_ml_footprints(spark, path)
    return found.groupBy(F.size("ring").cast("bigint").alias("points")).agg(F.count("*").alias("n"), F.round(F.sum("lon"), 2).alias("lon"), F.round(F.sum("lat"), 2).alias("lat"))


add("s4_ml_footprints", s4_ml_footprints,
    FOOTPRINTS_SQL + """, r AS (SELECT osm_id, count(*) AS points, avg(x) AS lon, avg(y) AS lat FROM rv WHERE ring_no = 0 AND osm_id::BIGINT % 11 <> 0 GROUP BY osm_id)
SELECT points, count(*) AS n, round(sum(lon), 2) AS lon, round(sum(lat), 2) AS lat FROM r GROUP BY points""")


def s4_footprints_in_patches(spark, sf):
    """The same lines in thousandths, and those in the boxes of 25 strips that share their borders' neighbourhoods."""
    ring = F.transform(F.concat("outer", F.slice("outer", 1, 1)), lambda p: F.array(p["x"] / 1000, p["y"] / 1000))
    path = folder(spark, "footprints")
    footprints(spark, sf).select(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")).write.json(path)
    strips = table(spark, sf, "nation").select(patch_name(F.col("n_nationkey")).alias("patch_id"), F.col("n_nationkey").alias("n"))
    at = {"lat_min": F.lit(-1.0), "lat_max": F.lit(1.0), "lon_min": F.col("n") * 0.23 - 2.9, "lon_max": F.col("n") * 0.23 - 2.65}
    found = readers.read_ml_footprints(spark, path, strips.select("patch_id", *[c.alias(k) for k, c in at.items()]))
    return found.groupBy("patch_id").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 4).alias("lon"), F.round(F.sum("lat"), 4).alias("lat"))


add("s4_footprints_in_patches", s4_footprints_in_patches,
    FOOTPRINTS_SQL + """, r AS (SELECT osm_id, avg(x / 1000) AS lon, avg(y / 1000) AS lat FROM rv WHERE ring_no = 0 GROUP BY osm_id),
s AS (SELECT printf('%03d%03d', n_nationkey % 5, n_nationkey // 5) AS patch_id, n_nationkey * 0.23::DOUBLE - 2.9::DOUBLE AS o0, n_nationkey * 0.23::DOUBLE - 2.65::DOUBLE AS o1 FROM nation)
SELECT patch_id, count(*) AS n, round(sum(lon), 4) AS lon, round(sum(lat), 4) AS lat FROM r JOIN s ON lon BETWEEN o0 AND o1 AND lat BETWEEN -1 AND 1 GROUP BY patch_id""")


def s5_tile_index(spark, sf):
    path = folder(spark, "tiles")
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.lit("x").alias("Location"), F.concat(F.lit("12"), (k % 97).cast("string")).alias("QuadKey"), F.concat(F.lit("u"), k.cast("string")).alias("Url"))
    rows.write.option("header", True).csv(path)
    return readers.read_tile_index(spark, path).select("quadkey", F.size("urls").cast("bigint").alias("n"), F.array_join(F.slice("urls", 1, 3), ",").alias("first_urls"))


add("s5_tile_index", s5_tile_index, """
u AS (SELECT '12' || c_custkey % 97 AS quadkey, 'u' || c_custkey AS url FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY quadkey ORDER BY url) AS nth FROM u)
SELECT quadkey, count(*) AS n, string_agg(url, ',' ORDER BY url) FILTER (nth <= 3) AS first_urls FROM r GROUP BY quadkey""")


def s6_airports(spark, sf):
    """The longest runways as a registry file (a few hundred names), read back with their zones."""
    found = pl.places.longest_runways(pl.airports(spark, sf))
    entry = F.struct("name", F.struct(F.col("length_m").alias("length"), F.array(F.lit(45.0), F.col("length_m") / 100).alias("center"), "source"))
    path = folder(spark, "airports")
    found.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value")).coalesce(1).write.text(path)
    return readers.read_airports(spark, path + "/part-*").select("name", "length_m", "lat", F.round("lon", 6).alias("lon"), "source", "zone_m")


add("s6_airports", s6_airports, pl.AIRPORT_SQL + """,
l AS (SELECT name, CASE WHEN source = 'aerodrome' THEN 1500 ELSE length_m END::DOUBLE AS length_m, source FROM ap
  WHERE length_m >= 50 QUALIFY row_number() OVER (PARTITION BY name ORDER BY source = 'aerodrome', source <> 'runway', length_m DESC) = 1)
SELECT name, length_m, 45::DOUBLE AS lat, round(length_m / 100, 6) AS lon, source, length_m / 2 + 458 AS zone_m FROM l""")


def s7_side_points(spark, sf):
    """Chimneys of a second extract in the patches' boxes, less a known third."""
    k = F.col("c_custkey")
    sites = table(spark, sf, "customer").select(k.cast("string").alias("node_id"), (F.lit(40.0) + k % 1000 / 100.0).alias("lat"), (F.lit(12.0) + k % 600 / 100.0).alias("lon"), k)
    kind = F.when(k % 2 == 0, "chimney").otherwise("mast")
    line = F.format_string('<node id="%s" lat="%s" lon="%s"><tag k="man_made" v="%s"/></node>', "node_id", F.col("lat").cast("string"), F.col("lon").cast("string"), kind)
    path = by_extract(sites.select(F.lit("999999").alias("patch_id"), line.alias("value"), F.lit(0).alias("kind")), folder(spark, "side"))
    return readers.read_side_points(spark, path + "/*/*", sites.where("c_custkey % 3 = 0"), pl.projected_patches(spark, sf)).select("patch_id", "node_id")


add("s7_side_points", s7_side_points, """
sp AS (SELECT printf('%03d%03d', s_suppkey % 1000, s_suppkey // 1000) AS patch_id, 40.005::DOUBLE + s_suppkey * 10 % 1000 / 100.0::DOUBLE AS a,
  12.005::DOUBLE + s_suppkey * 10 % 600 / 100.0::DOUBLE AS o FROM supplier),
st AS (SELECT c_custkey::VARCHAR AS node_id, 40 + (c_custkey % 1000) / 100.0::DOUBLE AS lat, 12 + (c_custkey % 600) / 100.0::DOUBLE AS lon FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0)
SELECT patch_id, node_id FROM st JOIN sp ON lat BETWEEN a - 0.03 AND a + 0.03 AND lon BETWEEN o - 0.05 AND o + 0.05""")


def s9_resolved_inputs(spark, sf):
    """Files of three kinds and four priorities; one in three patches lacks a kind."""
    k = F.col("o_orderkey")
    patch = patch_name(F.col("o_custkey") % 25)
    orders = table(spark, sf, "orders")
    files = orders.where((k % 3 != 0) | (F.col("o_custkey") % 3 != 0)).select(patch.alias("patch_id"), F.when(k % 3 == 0, "map").when(k % 3 == 1, "terrain")
        .otherwise("metadata").alias("kind"), F.concat(F.lit("f"), k.cast("string")).alias("path"), (k % 4).cast("int").alias("priority"))
    return readers.resolve_inputs(orders.select(patch.alias("patch_id")).distinct(), files).select("patch_id", "kind", "path", "priority", "missing")


add("s9_resolved_inputs", s9_resolved_inputs, """
o AS (SELECT printf('%03d%03d', (o_custkey % 25) % 5, (o_custkey % 25) // 5) AS patch_id, o_orderkey AS k, o_custkey AS c FROM orders),
f AS (SELECT patch_id, CASE k % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'terrain' ELSE 'metadata' END AS kind, 'f' || k AS path, (k % 4)::INT AS priority FROM o WHERE k % 3 <> 0 OR c % 3 <> 0),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY patch_id, kind ORDER BY priority, path) = 1), w AS (SELECT DISTINCT patch_id, unnest(['map', 'terrain', 'metadata']) AS kind FROM o)
SELECT patch_id, kind, path, priority, path IS NULL AS missing FROM w LEFT JOIN b USING (patch_id, kind)""")


def k1_written_faces(spark, sf):
    """Side walls written by patch, level and group; faces of two corners are left out."""
    wall, _ = fo.mesh_group(F.col("wall_kind"), F.col("actual_roof"), F.lit(1))
    faces = pa.side_walls(built(spark, sf).withColumn("grp", wall), [*pa.KEY, "grp"]).withColumn("lod", F.lit(0))
    short = F.when(F.col("osm_id").cast("bigint") % 6 == 0, F.slice("corners", 1, 2)).otherwise(F.col("corners"))
    path = folder(spark, "faces")
    sinks.write_faces(faces.withColumn("corners", short), path)
    return spark.read.schema(faces.schema).parquet(path).groupBy("patch_id", "lod", "grp").agg(F.count("*").alias("n"))


add("k1_written_faces", k1_written_faces, WALLS_SQL + """
SELECT patch_id, 0 AS lod, CASE WHEN actual_roof <> 'flat' THEN 'houses' WHEN wall_kind = 'highrise' THEN 'Highrise_walls' ELSE 'industrial_walls' END AS grp,
  count(*) AS n FROM we WHERE osm_id::BIGINT % 6 <> 0 GROUP BY ALL""")


def k3_r5_written_report(spark, sf):
    """The report of each patch with counts of optional features: one without rows never takes a patch's report away (those that fail: r5_independent_features)."""
    report = fo.report(_full(spark, sf))
    features = {"chimneys": pl.supports(spark, sf).where("kind = 'chimney'"), "zones": pl.zones(spark, sf).where("zone_m > 2000")}
    path = folder(spark, "report")
    sinks.write_report(fo.with_features(report, features), path)
    return spark.read.schema("patch_id string, parsed long, processed long, chimneys long, zones long").json(path)


add("k3_r5_written_report", k3_r5_written_report, f"""{FOOTPRINTS_SQL}{CLASSES_SQL}, {pl.POINTS_SQL}, {pl.ZONES_SQL},
r AS (SELECT patch_id, count(*) AS parsed, count_if(filter_reason = 'kept')::BIGINT AS processed FROM d GROUP BY patch_id), ch AS (SELECT patch_id, count(*) AS chimneys FROM pt WHERE kind = 'chimney' GROUP BY patch_id),
z AS (SELECT patch_id, count(*) AS zones FROM zn WHERE zone_m > 2000 GROUP BY patch_id)
SELECT patch_id, parsed, processed, coalesce(chimneys, 0) AS chimneys, coalesce(zones, 0) AS zones FROM r LEFT JOIN ch USING (patch_id) LEFT JOIN z USING (patch_id)""")


def k4_run_log(spark, sf):
    """The run of each patch, appended twice."""
    path = folder(spark, "log")
    rows = table(spark, sf, "orders").groupBy(patch_name(F.col("o_custkey") % 25).alias("patch_id")).agg(F.count("*").alias("buildings"))
    for _ in range(2):
        sinks.append_run_log(rows, path)
    logged = spark.read.schema("patch_id string, buildings long, logged_at timestamp").parquet(path)
    return logged.groupBy("patch_id").agg(F.count("*").alias("runs"), F.sum("buildings").alias("buildings"), F.count("logged_at").alias("times"))


add("k4_run_log", k4_run_log, """
p AS (SELECT printf('%03d%03d', (o_custkey % 25) % 5, (o_custkey % 25) // 5) AS patch_id, count(*) AS n FROM orders GROUP BY ALL) SELECT patch_id, 2::BIGINT AS runs,
  2 * n AS buildings, 2::BIGINT AS times FROM p""")


def x1_new_patches(spark, sf):
    """Footprints arrive as files, then those of every patch of the first column again, without holes: each patch holds what came last."""
    source, target, marks = (folder(spark, n) for n in ("in", "out", "marks"))
    every = footprints(spark, sf).select("patch_id", "osm_id", "outer", "holes")
    run = lambda: process_new_patches(spark, source, every.schema, lambda rows: fo.measured(rows).select("patch_id", "osm_id", "area"), target, marks).awaitTermination()
    every.write.mode("append").parquet(source)
    run()
    again = every.where("patch_id LIKE '000%' AND size(holes) = 0")
    again.write.mode("append").parquet(source)
    run()
    return spark.read.schema("osm_id string, area double, patch_id string").parquet(target).groupBy("patch_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"))


add("x1_new_patches", x1_new_patches, f"""{FOOTPRINTS_SQL}{CLASSES_SQL}
SELECT patch_id, count(*) AS n, round(sum(area), 3) AS area FROM d WHERE NOT (patch_id LIKE '000%' AND has_hole) GROUP BY patch_id""")
