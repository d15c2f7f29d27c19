"""Queries over map elements derived from the footprints, and their SQL.

Every footprint vertex is a node; plain buildings are closed ways, those with a
hole are relations of two outer halves (one of them turned round) and an inner
way. A node of every fiftieth building is missing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions import rings
from terralith.operators import elements as el
from terralith.plans.derived import FOOTPRINTS_SQL, footprints

Q: dict = {}
O: dict = {}  # noqa: E741

ELEMENTS_SQL = FOOTPRINTS_SQL + """
, nd AS (SELECT patch_id, osm_id || '-' || ring_no || '-' || pos AS node_id, osm_id, ring_no, pos, x AS lon, y AS lat FROM rv WHERE NOT (osm_id::BIGINT % 50 = 0 AND ring_no = 0 AND pos = 1)),
cl AS (SELECT patch_id, osm_id, ring_no, n, unnest(range(n + 1)) AS pos FROM (SELECT patch_id, osm_id, ring_no, count(*) AS n FROM rv GROUP BY ALL)),
rf AS (SELECT patch_id, osm_id, ring_no, pos, osm_id || '-' || ring_no || '-' || (pos % n) AS node_id FROM cl)
"""


def add(name: str, query, sql: str) -> None:
    Q[name] = query
    O[name] = f"WITH {ELEMENTS_SQL}{sql}"


def elements(spark, sf, base=None):
    """(nodes, ways, relations) of the footprints, or of ``base``: the same as a written table, where much is made from them."""
    base = (footprints(spark, sf) if base is None else base).withColumn("all_rings", F.concat(F.array("outer"), F.col("holes")))
    ring = base.select("patch_id", "osm_id", "k", "building_tag", (F.size("holes") > 0).alias("has_hole"), F.posexplode("all_rings").alias("ring_no", "ring"))
    named = ring.withColumn("ids", F.transform("ring", lambda p, i: F.concat_ws("-", F.col("osm_id"), F.col("ring_no").cast("string"), i.cast("string"))))
    each = named.select("patch_id", "k", "ring_no", F.posexplode("ring").alias("pos", "p"), "ids")
    nodes = each.where("NOT (k % 50 = 0 AND ring_no = 0 AND pos = 1)").select("patch_id", F.get("ids", F.col("pos")).alias("node_id"), F.col("p.y").alias("lat"),
        F.col("p.x").alias("lon"), F.create_map().cast("map<string,string>").alias("tags"))
    closed = F.concat("ids", F.slice("ids", 1, 1))
    tags = F.when((F.col("ring_no") == 0) & ~F.col("has_hole"),
        F.map_concat(F.create_map(F.lit("building"), F.col("building_tag")), F.when(F.col("k") % 13 == 0, F.create_map(F.lit("disused:shop"), F.lit("yes")))
        .otherwise(F.create_map().cast("map<string,string>")))).otherwise(F.create_map().cast("map<string,string>"))
    whole = named.where("NOT has_hole OR ring_no > 0").select("patch_id", F.concat_ws("/", "osm_id", F.col("ring_no").cast("string")).alias("way_id"), closed.alias("refs"), tags.alias("tags"))
    split = named.where("has_hole AND ring_no = 0").select("patch_id", "osm_id",
        F.posexplode(F.array(F.slice("ids", 1, 3), F.reverse(F.concat(F.slice("ids", 3, 9), F.slice("ids", 1, 1))))).alias("half", "refs"))
    halves = split.select("patch_id", F.concat(F.col("osm_id"), F.lit("/0"), F.when(F.col("half") == 0, "a").otherwise("b")).alias("way_id"), "refs",
        F.create_map().cast("map<string,string>").alias("tags"))
    member = lambda suffix, role: F.struct(F.lit("way").alias("type"), F.concat(F.col("osm_id"), F.lit(suffix)).alias("ref"), F.lit(role).alias("role"))
    relations = base.where(F.size("holes") > 0).select("patch_id", F.concat(F.lit("r"), "osm_id").alias("rel_id"),
        F.array(member("/0b", ""), member("/1", "inner"), member("/0a", "outer")).alias("members"),
        F.create_map(F.lit("type"), F.lit("multipolygon"), F.lit("building"), F.col("building_tag")).alias("tags"))
    return nodes, whole.unionByName(halves), relations


add("j1_way_points", lambda s, d: (lambda n, w, r: el.way_points(w.where(F.map_contains_key("tags", F.lit("building"))), n).groupBy("way_id")
    .agg(F.count("*").alias("points"), F.round(F.sum("lon"), 4).alias("sum_lon")))(*elements(s, d)),
    "SELECT rf.osm_id || '/0' AS way_id, count(*) AS points, round(sum(lon), 4) AS sum_lon FROM rf JOIN nd USING (node_id) WHERE rf.ring_no = 0 AND rf.osm_id::BIGINT % 10 <> 9 GROUP BY ALL")
add("j2_missing_refs", lambda s, d: (lambda n, w, r: el.missing_refs(w, n).select("way_id", "node_id"))(*elements(s, d)),
    "SELECT rf.osm_id || '/0' AS way_id, node_id FROM rf ANTI JOIN nd USING (node_id) WHERE rf.osm_id::BIGINT % 10 <> 9 UNION ALL SELECT osm_id || '/0a', node_id "
    "FROM rf ANTI JOIN nd USING (node_id) WHERE osm_id::BIGINT % 10 = 9")
add("j3_r1_r3_relation_polygons", lambda s, d: (lambda n, w, r: el.relation_polygons(r, w, n)
    .select("rel_id", F.size("holes").cast("bigint").alias("holes"), F.round(rings.area(F.col("outer"), F.col("holes")), 4).alias("area")))(*elements(s, d)),
    ", sa AS (SELECT osm_id, ring_no, abs(sum(x * y2 - x2 * y) / 2) AS a FROM edges GROUP BY ALL) SELECT 'r' || o.osm_id AS rel_id, 1::BIGINT AS holes, round(o.a - i.a, "
    "4) AS area FROM sa o JOIN sa i ON o.osm_id = i.osm_id AND o.ring_no = 0 AND i.ring_no = 1")
add("j4_e1_f1_buildings", lambda s, d: (lambda n, w, r: el.buildings(n, w, r).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("holes")).cast("bigint").alias("holes")))(*elements(s, d)),
    "SELECT CASE WHEN has_hole THEN 'relation' ELSE 'way' END AS kind, count(*) AS n, sum(CASE WHEN has_hole THEN 1 ELSE 0 END)::BIGINT AS holes FROM fp GROUP BY ALL")
add("f9_f10_tag_predicates", lambda s, d: (lambda n, w, r: w.where(el.in_tag_query(F.col("tags"))).groupBy(el.is_disused(F.col("tags")).alias("disused"))
    .agg(F.count("*").alias("n")))(*elements(s, d)),
    "SELECT k % 13 = 0 AS disused, count(*) AS n FROM fp WHERE NOT has_hole GROUP BY ALL")
add("a16_parse_statistics", lambda s, d: (lambda n, w, r: el.parse_statistics(n, w, r).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("buildings").alias("buildings")))(*elements(s, d)),
    "SELECT 'node' AS kind, count(*) AS n, 0::BIGINT AS buildings FROM nd UNION ALL SELECT 'way', count(*) + 2 * count_if(has_hole)::BIGINT, "
    "count_if(NOT has_hole)::BIGINT FROM fp UNION ALL SELECT 'relation', count_if(has_hole)::BIGINT, count_if(has_hole)::BIGINT FROM fp")
