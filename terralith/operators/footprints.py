"""Measured and classified footprints, tile filters and reports.

Everything about a building is computed inside its row; only reports aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import kernels, rings, roofs, tags

HALF = 2880.0


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are evaluated once per row.

    A plain projection is inlined wherever a later filter or expression uses it,
    and steps of nested measures would multiply. A one-row generator isn't.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def measured(buildings: DataFrame) -> DataFrame:
    """Adds area, perimeter, box, vertex count, convexity, oriented box, fill, aspect and has_holes to (outer, holes)."""
    kept = buildings.select("*", kernels.ring_measures("outer", "holes").alias("measures"))
    return shaped(kept.select("*", "measures.*", (F.size("holes") > 0).alias("has_holes")).drop("measures"))


def shaped(found: DataFrame) -> DataFrame:
    """Adds the oriented box's sides, aspect and fill to ring measures."""
    long, short = F.greatest("obb.length", "obb.width"), F.least("obb.length", "obb.width")
    # Rounded, so that a limit met exactly doesn't depend on the last bits of a rotation.
    aspect, fill = F.when(short > 1e-9, long / short).otherwise(F.lit(float("inf"))), F.try_divide(F.col("area"), long * short)
    return computed(found, {"obb_length": F.round(long, 9), "obb_width": F.round(short, 9), "aspect": F.round(aspect, 9), "fill": F.round(fill, 9)})


def convexity(buildings: DataFrame) -> DataFrame:
    """Adds convexity_ratio, the outer ring's area by that of its hull (0 for rings without area)."""
    area, of_hull = F.abs(rings.signed_area(F.col("outer"))), kernels.hull_area("outer")
    return buildings.withColumn("hull_area", of_hull).withColumn("convexity_ratio", F.when((area < 1e-10) | (F.col("hull_area") < 1e-10), 0.0).otherwise(area / F.col("hull_area")))


def attributed(buildings: DataFrame) -> DataFrame:
    """Adds category, size, roof shape, pitch, direction and seed from the tag columns."""
    with_kind = computed(
        buildings,
        {
            "category": tags.category(F.col("building_tag")), "shape_asked": tags.roof_shape(F.col("roof_shape_tag")), "tagged_height": tags.height(F.col("height_tag")),
            "pitch": tags.roof_pitch(F.col("roof_angle_tag")), "direction": tags.roof_direction(F.col("roof_direction_tag")), "seed": tags.stable_seed(F.col("osm_id")),
        },
    )
    guess = computed(with_kind, {"tag_floors": tags.floors(F.col("levels_tag"), F.col("tagged_height"), tags.estimated_floors(F.col("area"), F.col("category")))})
    size = computed(guess, {"size": tags.reconciled(F.col("tagged_height"), F.col("tag_floors"), F.col("area"), F.col("category"))})
    return size.select("*", F.col("size.floors").alias("floors"), F.col("size.height_m").alias("height_m"), F.col("size.clamped").alias("clamped")).drop("size")


def classified(buildings: DataFrame, mode: str = "geometry", house_limits: dict | None = None) -> DataFrame:
    """Adds roof_asked, eligibility, scale, skeleton, actual_roof, fallback_reason and wall_kind."""
    ruled = computed(
        buildings,
        {
            "roof_asked": roofs.select_roof(F.col("shape_asked"), F.col("category"), F.col("floors"), F.col("height_m"), F.col("area"), mode),
            "eligibility": roofs.eligibility(F.col("vertices"), F.col("has_holes"), F.col("convex"), F.col("rectangle_like"), F.col("fill"), F.col("aspect")),
            "scale": roofs.house_scale(F.col("area"), F.col("obb_length"), F.col("obb_width"), F.col("aspect"), house_limits),
        },
    )
    found = computed(
        ruled,
        {
            "decision": roofs.decided(F.col("roof_asked"), F.col("eligibility"), F.col("scale"), F.col("floors")),
            "skeleton": roofs.skeleton_candidate(F.col("eligibility"), F.col("vertices"), F.col("has_holes"), F.col("scale"), F.col("floors")),
        },
    )
    roof = found.select("*", F.col("decision.actual_roof").alias("actual_roof"), F.col("decision.fallback_reason").alias("fallback_reason")).drop("decision")
    return computed(roof, {"wall_kind": roofs.wall_kind(F.col("category"), F.col("area"), F.col("actual_roof"))})


def patch_status(bbox: Column, half: float = HALF) -> Column:
    """kept, partially_outside_patch or outside_patch_bounds."""
    inside = (bbox["min_x"] >= -half) & (bbox["max_x"] <= half) & (bbox["min_y"] >= -half) & (bbox["max_y"] <= half)
    apart = (bbox["max_x"] < -half) | (bbox["min_x"] > half) | (bbox["max_y"] < -half) | (bbox["min_y"] > half)
    return F.when(inside, "kept").when(apart, "outside_patch_bounds").otherwise("partially_outside_patch")


def within_patch(buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, filtered with a reason)"""
    judged = buildings.withColumn("filter_reason", patch_status(F.col("bbox")))
    return judged.where("filter_reason = 'kept'").drop("filter_reason"), judged.where("filter_reason <> 'kept'")


def mesh_group(wall_kind: Column, actual_roof: Column, bucket: Column, industrial: Column | None = None, folded: bool = True) -> tuple[Column, Column]:
    """(wall group, roof group).

    Pitched buildings are houses; their roofs are groups of their own unless ``folded``.
    Walls under flat roofs are high-rise or industrial; flat roofs go to their bucket, or,
    where ``industrial`` (a condition) is given, those of industrial buildings to one group.
    """
    pitched = F.lit("houses") if folded else F.when(actual_roof == "gabled", "gabled_roofs_lod0").otherwise("hipped_roofs")
    walls = F.when(actual_roof != "flat", "houses").when(wall_kind == "highrise", "Highrise_walls").otherwise("industrial_walls")
    numbered = F.concat(F.lit("flat_roof_"), bucket.cast("string"))
    flat = numbered if industrial is None else F.when(industrial, "flat_roof").otherwise(numbered)
    return walls, F.when(actual_roof != "flat", pitched).otherwise(flat)


def report(buildings: DataFrame) -> DataFrame:
    """One row per patch of counts, from classified buildings with a filter_reason."""
    kept = F.col("filter_reason") == "kept"
    count = lambda c: F.count_if(kept & c)
    return buildings.groupBy("patch_id").agg(
        F.count("*").alias("parsed"), F.count_if(~kept).alias("filtered"), F.count_if(kept).alias("processed"), count(F.col("eligibility") == "eligible").alias("eligible"),
        count(F.col("scale") == "ok").alias("house_scale"), count(F.col("actual_roof") == "gabled").alias("gabled"), count(F.col("actual_roof") == "hipped").alias("hipped"),
        count(F.col("actual_roof") == "flat").alias("flat"), count(F.col("roof_asked") != F.col("actual_roof")).alias("fallbacks"), count(F.col("skeleton")).alias("skeleton_candidates"), count(F.col("clamped")).alias("clamped_sizes"),
    )


def fallback_counts(buildings: DataFrame) -> DataFrame:
    """(patch_id, fallback_reason, n) of buildings that didn't get the roof asked for."""
    return buildings.where("filter_reason = 'kept' AND roof_asked <> actual_roof").groupBy("patch_id", "fallback_reason").agg(F.count("*").alias("n"))


def fallback_map(buildings: DataFrame) -> DataFrame:
    """(patch_id, fallbacks map<reason, n>)"""
    pairs = F.sort_array(F.collect_list(F.struct("fallback_reason", "n")))
    return fallback_counts(buildings).groupBy("patch_id").agg(F.map_from_entries(pairs).alias("fallbacks"))


def vertex_bucket(n: Column) -> Column:
    return F.when(n == 4, "4").when(n <= 6, "5_to_6").when(n <= 8, "7_to_8").otherwise("9_plus")


def top_buildings(buildings: DataFrame, k: int = 10) -> DataFrame:
    """The k buildings with most vertices of each patch, ties by id."""
    order = Window.partitionBy("patch_id").orderBy(F.desc("vertices"), F.desc("area"), "osm_id")
    return buildings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def warnings(buildings: DataFrame, k: int) -> DataFrame:
    """(patch_id, nth, osm_id, warning, total): the first k warnings of each patch, by id, and how many it has.

    A building whose size was clamped is warned of with its address, from the columns
    ``address`` where there is one; it stays among the buildings.
    """
    address = F.coalesce(F.nullif(F.trim(F.col("address")), F.lit("")), F.lit("no address"))
    text = F.format_string("Clamped size of %s (%s, building=%s): floors %d, height %.1f m", "osm_id", address, F.coalesce("building_tag", F.lit("yes")), "floors", "height_m")
    found = buildings.where("clamped").select("patch_id", "osm_id", text.alias("warning"))
    order = Window.partitionBy("patch_id").orderBy(F.col("osm_id").try_cast("bigint"), "osm_id")
    return found.withColumns({"nth": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy("patch_id"))}).where(F.col("nth") <= k)


def with_features(report_: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """A report by patch with the number of rows of each optional feature; 0 where a patch has none."""
    for name, rows in features.items():
        counted = rows.groupBy("patch_id").agg(F.count("*").alias(name))
        report_ = report_.join(counted, "patch_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return report_
