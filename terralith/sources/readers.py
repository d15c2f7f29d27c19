"""Readers of map extracts, patch files, terrain, footprints, tile indexes and airports.

Schemas are explicit everywhere; ids stay strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.sources import mapxml

#: The last six digits of their own in a path: a file's name holds its patch, or else its folder's.
PATCH = r".*[/_=h]([0-9]{6})(?:[/_.]|$)"
#: Fields of a patch file, by their names without underscores in lower case.
PATCH_FIELDS = {"zonenumber": "zone_number", "translatex": "translate_x", "translatey": "translate_y", "latmin": "lat_min", "latmax": "lat_max", "lonmin": "lon_min", "lonmax": "lon_max"}


def _patch_of_file() -> F.Column:
    return F.regexp_extract(F.input_file_name(), PATCH, 1)


def read_map_elements(
    spark: SparkSession, path: str | list[str], patch: Column | None = None, kept: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of map extracts; the last of repeated tags wins. ``patch``: a file's patch id by its ``path``, else that of its name.

    A file is parsed once for what is asked of it: for each of the three, or for all, where ``kept`` is given. It gets
    the table of all elements by kind (``mapxml.SCHEMA``) and returns it as written.
    """
    files = spark.read.format("binaryFile").load(path).select((F.regexp_extract("path", PATCH, 1) if patch is None else patch).alias("patch_id"), "content")
    every = lambda kinds: files.mapInArrow(lambda batches: mapxml.elements(batches, kinds), mapxml.SCHEMA)
    whole = None if kept is None else kept(every(mapxml.KINDS))
    one = lambda kind: (every((kind,)) if whole is None else whole).where(F.col("kind") == kind)
    nodes = one("node").select("patch_id", F.col("id").alias("node_id"), "lat", "lon", "tags")
    ways = one("way").select("patch_id", F.col("id").alias("way_id"), "refs", "tags")
    members = F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), F.coalesce(m["role"], F.lit("")).alias("role")))
    return nodes, ways, one("relation").select("patch_id", F.col("id").alias("rel_id"), members.alias("members"), "tags")


def read_patch_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per patch file of ``key: value`` lines, with the names of missing fields."""
    lines = spark.read.option("wholetext", True).text(path).select(_patch_of_file().alias("patch_id"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    pair = lines.where(F.col("line").contains(":")).select("patch_id", F.lower(F.replace(F.trim(F.split_part("line", F.lit(":"), F.lit(1))), F.lit("_"), F.lit(""))).alias("key"), F.trim(F.split_part("line", F.lit(":"), F.lit(2))).try_cast("double").alias("value"))
    picked = pair.groupBy("patch_id").agg(*[F.max(F.when(F.col("key") == key, F.col("value"))).alias(name) for key, name in PATCH_FIELDS.items()])
    missing = F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in PATCH_FIELDS.values()]), lambda n: n.isNotNull())
    return picked.withColumn("errors", missing).withColumn("zone_number", F.col("zone_number").cast("int"))


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    """Triangles (patch_id, tri, x1..z3) of ``v``/``f`` files; quads split at their first corner, degenerate halves dropped."""
    lines = spark.read.option("wholetext", True).text(path).select(_patch_of_file().alias("patch_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).withColumn("w", F.split(F.trim("line"), r"\s+"))
    order = Window.partitionBy("patch_id").orderBy("line_no")
    v = lines.where(F.col("w")[0] == "v").withColumn("n", F.row_number().over(order)).select("patch_id", "n", *[F.col("w")[i].cast("double").alias(c) for i, c in enumerate("xyz", 1)])
    faces = lines.where(F.col("w")[0] == "f").withColumns({"face": F.row_number().over(order) - 1, "i": F.transform(F.slice("w", 2, 4), lambda t: F.split(t, "/")[0].cast("int"))})
    quad = faces.withColumn("q", F.when(F.size("i") == 3, F.concat("i", F.slice("i", 3, 1))).otherwise(F.col("i")))
    half = lambda k, a, b, c: F.struct((F.col("face") * 2 + k).alias("tri"), F.col("q")[a].alias("a"), F.col("q")[b].alias("b"), F.col("q")[c].alias("c"))
    tri = quad.select("patch_id", F.inline(F.array(half(0, 0, 1, 2), half(1, 0, 2, 3)))).where("a <> b AND b <> c AND a <> c")
    for k, name in enumerate("abc", 1):
        corner = v.select("patch_id", F.col("n").alias(name), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        tri = tri.join(corner, ["patch_id", name])
    return tri.drop("a", "b", "c")


def in_boxes(points: DataFrame, patches: DataFrame) -> DataFrame:
    """Points (lat, lon) with the patch_id of each patch whose box (lat_min .. lon_max) they lie in, borders included.

    Boxes are listed in the cells of a tenth of a degree that they touch, points in their own.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) * 10).cast("int"), F.floor(F.col(high) * 10).cast("int")))
    boxes = patches.select("patch_id", "lat_min", "lat_max", "lon_min", "lon_max", cells("lat_min", "lat_max").alias("gy")).select("*", cells("lon_min", "lon_max").alias("gx"))
    own = points.withColumns({"gy": F.floor(F.col("lat") * 10).cast("int"), "gx": F.floor(F.col("lon") * 10).cast("int")})
    inside = own.join(boxes, ["gx", "gy"]).where(F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max")))
    return inside.select("patch_id", *points.columns)


def read_ml_footprints(spark: SparkSession, path: str, patches: DataFrame | None = None) -> DataFrame:
    """Polygons of JSON lines: ring (lon, lat without the closing repeat) and its vertex mean; rings under 3 points go.

    With ``patches`` (patch_id, lat_min .. lon_max) only those whose vertex mean lies in a patch's box, with its patch_id.
    """
    raw = spark.read.schema("geometry struct<type:string,coordinates:array<array<array<double>>>>").json(path).where("geometry.type = 'Polygon'")
    ring = F.transform(F.col("geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    opened = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))
    rings = raw.select(ring.alias("ring")).where("size(ring) >= 3").select(opened.alias("ring")).where("size(ring) >= 3")
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[c]) / F.size("ring")
    found = rings.select("ring", mean("x").alias("lon"), mean("y").alias("lat"))
    return found if patches is None else in_boxes(found, patches)


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """(quadkey, urls) of a CSV whose second and third columns are quadkey and url."""
    return spark.read.option("header", True).schema("location string, quadkey string, url string").csv(path).groupBy("quadkey").agg(F.sort_array(F.collect_list("url")).alias("urls"))


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """(name, length_m, lat, lon, source, zone_m) of a registry file."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string, struct<length: double, center: array<double>, source: string>>")).alias("name", "a"))
    return raw.select("name", F.col("a.length").alias("length_m"), F.col("a.center")[0].alias("lat"), F.col("a.center")[1].alias("lon"), F.col("a.source").alias("source"), (F.col("a.length") / 2 + 458).alias("zone_m"))


def read_side_points(spark: SparkSession, path: str, known: DataFrame, patches: DataFrame, key: str = "man_made", value: str = "chimney") -> DataFrame:
    """Tagged nodes of a second extract that lie in a patch's box and aren't known yet."""
    nodes, _, _ = read_map_elements(spark, path)
    tagged = nodes.drop("patch_id").where(F.col("tags")[key] == value)
    inside = in_boxes(tagged.select("node_id", "lat", "lon", "tags"), patches)
    return inside.join(known.select("node_id"), "node_id", "left_anti").select("patch_id", "node_id", "lat", "lon", "tags")


def patch_grid(spark: SparkSession, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Patch ids of a range of columns and rows."""
    return spark.range(y0, y1 + 1).select(F.col("id").alias("py"), F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("px")).select(F.format_string("%03d%03d", F.col("px").cast("int"), F.col("py").cast("int")).alias("patch_id"), "px", "py")


def resolve_inputs(patches: DataFrame, files: DataFrame) -> DataFrame:
    """The best file per patch and kind from (patch_id, kind, path, priority): lowest priority, then path; null path where none is there."""
    best = Window.partitionBy("patch_id", "kind").orderBy("priority", "path")
    chosen = files.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    wanted = patches.select("patch_id", F.explode(F.array(F.lit("map"), F.lit("terrain"), F.lit("metadata"))).alias("kind"))
    return wanted.join(chosen, ["patch_id", "kind"], "left").withColumn("missing", F.col("path").isNull())
