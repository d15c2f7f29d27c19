"""Map elements to building rings: ways and relations joined to nodes, rings stitched."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.functions import kernels


def has(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def is_building(tags: Column) -> Column:
    """A building tag, and neither a chimney nor a communication mast."""
    mast = F.exists(F.map_keys(tags), lambda k: (k == "communication") | k.startswith("communication:"))
    return has(tags, "building") & (F.coalesce(tags["building"], F.lit("")) != "no") & ~F.coalesce(tags["man_made"] == "chimney", F.lit(False)) & ~F.coalesce(mast, F.lit(False))


def is_transmitter(tags: Column) -> Column:
    return F.coalesce(tags["man_made"].isin("communications_tower", "mast", "tower") & (has(tags, "communication") | F.exists(F.map_keys(tags), lambda k: k.startswith("communication:")) | F.coalesce(tags["tower:type"] == "communication", F.lit(False))), F.lit(False))


def is_wind_turbine(tags: Column) -> Column:
    return F.coalesce((tags["power"] == "generator") & (tags["generator:source"] == "wind"), F.lit(False))


def is_chimney(tags: Column) -> Column:
    return F.coalesce(tags["man_made"] == "chimney", F.lit(False))


def is_aerodrome(tags: Column) -> Column:
    return F.coalesce(tags["aeroway"] == "aerodrome", F.lit(False))


def is_runway(tags: Column) -> Column:
    return F.coalesce(tags["aeroway"] == "runway", F.lit(False))


def is_disused(tags: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: k.contains("disused") | k.contains("abandoned")), F.lit(False))


def in_tag_query(tags: Column) -> Column:
    """What a patch extract has to contain."""
    keys = ["building", "power", "aerialway", "aeroway"]
    found = F.lit(False)
    for k in keys:
        found |= has(tags, k)
    return found | F.coalesce((tags["man_made"].isin("chimney", "bridge")), F.lit(False))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(patch_id, way_id, pos, node_id, lat, lon): a way's nodes in order; references without a node are skipped."""
    refs = ways.select("patch_id", "way_id", F.posexplode("refs").alias("pos", "node_id"))
    # Ids before patches: Spark sorts by the first bytes of the first column, and all elements of a patch have its name.
    return refs.join(nodes.select("patch_id", "node_id", "lat", "lon"), ["node_id", "patch_id"]).select("patch_id", "node_id", "way_id", "pos", "lat", "lon")


def missing_refs(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    refs = ways.select("patch_id", "way_id", F.posexplode("refs").alias("pos", "node_id"))
    return refs.join(nodes.select("patch_id", "node_id"), ["patch_id", "node_id"], "left_anti")


def way_rings(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rings, rejected): each way's ring without a closing repeat, and the ways left with under three points."""
    gathered = points.groupBy("patch_id", "way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    opened = gathered.withColumn("p", F.when((F.size("p") > 1) & (first["node_id"] == last["node_id"]), F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p")))
    ring = opened.select("patch_id", "way_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))
    return ring.where("size(ring) >= 3"), ring.where("size(ring) < 3").select("patch_id", "way_id", F.lit("fewer than three points").alias("reason"))


def member_ways(relations: DataFrame) -> DataFrame:
    """(patch_id, rel_id, pos, way_id, role) of multipolygon relations; an empty role is outer."""
    each = relations.where(F.coalesce(F.col("tags")["type"], F.lit("")) == "multipolygon").select("patch_id", "rel_id", F.posexplode("members").alias("pos", "m"))
    return each.where("m.type = 'way'").select("patch_id", "rel_id", "pos", F.col("m.ref").alias("way_id"), F.when(F.col("m.role") == "", "outer").otherwise(F.col("m.role")).alias("role"))


def _closed_chains(ways: list[list[str]]) -> list[tuple[list[str], bool]]:
    """Chains of ways joined end to end in their order, and whether each is a closed ring."""
    done, used = [], [False] * len(ways)
    for start in range(len(ways)):
        if used[start]:
            continue
        used[start], chain, grown = True, ways[start], True
        while chain[0] != chain[-1] and grown:
            grown = False
            for k, other in enumerate(ways):
                if used[k] or chain[-1] not in (other[0], other[-1]):
                    continue
                chain = chain + (other[1:] if other[0] == chain[-1] else other[-2::-1])
                used[k], grown = True, True
                break
        done.append((chain, chain[0] == chain[-1] and len(chain) >= 4))
    return done


@F.arrow_udf(T.ArrayType(kernels.struct(ring_no=T.IntegerType(), refs=T.ArrayType(T.StringType()), closed=T.BooleanType())))
def _stitch(parts: pa.Array) -> pa.Array:
    """Rings of the ways (refs) of each list, many relations a batch."""
    kind = pa.list_(pa.struct([("ring_no", pa.int32()), ("refs", pa.list_(pa.string())), ("closed", pa.bool_())]))
    found = (_closed_chains([p["refs"] for p in ways if len(p["refs"]) > 1]) for ways in parts.to_pylist())
    return pa.array([[{"ring_no": n, "refs": chain, "closed": closed} for n, (chain, closed) in enumerate(rings_)] for rings_ in found], kind)


def stitched(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(patch_id, rel_id, role, ring_no, refs, closed): rings of the relations' ways, joined end to end in member order; the rest isn't closed."""
    parts = member_ways(relations).join(ways.select("patch_id", "way_id", "refs"), ["patch_id", "way_id"])
    gathered = parts.groupBy("patch_id", "rel_id", "role").agg(F.sort_array(F.collect_list(F.struct("pos", "refs"))).alias("parts"))
    return gathered.select("patch_id", "rel_id", "role", F.inline(_stitch("parts")))


def relation_polygons(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(patch_id, rel_id, outer, holes): the first closed outer ring and all closed holes, wound outward and inward."""
    closed = stitched(relations, ways).where("closed")
    # The key says what a ring belongs to, so that its points need not be joined with it again.
    ring, _ = way_rings(way_points(closed.select("patch_id", F.struct("rel_id", "role", "ring_no").alias("way_id"), "refs"), nodes))
    role = F.col("way_id.role")
    turned = F.when(role == "outer", kernels.signed_area("ring") < 0).otherwise(kernels.signed_area("ring") > 0)
    each = ring.select("patch_id", "way_id.*", F.when(turned, F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))
    is_outer, is_inner = F.col("role") == "outer", F.col("role") == "inner"
    found = each.groupBy("patch_id", "rel_id").agg(
        F.min_by(F.when(is_outer, F.col("ring")), F.when(is_outer, F.col("ring_no"))).alias("outer"), F.sort_array(F.collect_list(F.when(is_inner, F.struct("ring_no", "ring")))).alias("r")
    )
    return found.where("outer IS NOT NULL").select("patch_id", "rel_id", "outer", F.col("r.ring").alias("holes"))


def buildings(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(patch_id, osm_id, kind, tags, outer, holes): relation buildings, and ways that no built relation used."""
    wanted = relations.where(is_building(F.col("tags")))
    polygons = relation_polygons(wanted, ways, nodes)
    by_relation = polygons.join(relations.select("patch_id", "rel_id", "tags"), ["patch_id", "rel_id"]).select("patch_id", F.col("rel_id").alias("osm_id"), F.lit("relation").alias("kind"), "tags", "outer", "holes")
    used = member_ways(wanted).join(polygons.select("patch_id", "rel_id"), ["patch_id", "rel_id"], "left_semi").select("patch_id", "way_id")
    free = ways.where(is_building(F.col("tags"))).join(used, ["patch_id", "way_id"], "left_anti")
    ring, _ = way_rings(way_points(free, nodes))
    empty = F.filter(F.array("outer"), lambda r: F.lit(False))
    by_way = ring.join(free.select("patch_id", "way_id", "tags"), ["patch_id", "way_id"]).select("patch_id", F.col("way_id").alias("osm_id"), F.lit("way").alias("kind"), "tags", F.when(kernels.signed_area("ring") < 0, F.reverse("ring")).otherwise(F.col("ring")).alias("outer")).select("*", empty.alias("holes"))
    return by_relation.unionByName(by_way)


def parse_statistics(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Elements per patch and kind."""
    count = lambda df, kind: df.groupBy("patch_id").agg(F.count("*").alias("n"), F.count_if(is_building(F.col("tags"))).alias("buildings")).withColumn("kind", F.lit(kind))
    return count(nodes, "node").unionByName(count(ways, "way")).unionByName(count(relations, "relation"))
