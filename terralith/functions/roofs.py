"""Roof and wall decisions as ordered rules over measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the rules.
MAX_VERTICES, MIN_FILL, MIN_ASPECT, MAX_ASPECT = 4, 0.70, 0.20, 6.0
HOUSE_AREA, HOUSE_SIDE, HOUSE_MIN_SIDE, HOUSE_ASPECT = 360.0, 30.0, 3.2, 4.8
#: The command line's own house limits.
CLI_HOUSE = {"area": 300.0, "side": 25.0, "min_side": 4.0, "aspect": 4.0}
MAX_FLOORS, SKELETON_VERTICES = 2, 12
GABLE_M = 3.0


def select_roof(shape: Column, kind: Column, floors: Column, height: Column, area: Column, mode: str = "geometry") -> Column:
    """The roof asked for: an explicit shape, or rules by category and size where it is gabled, the default."""
    by_floors = F.when(floors > MAX_FLOORS, "flat").otherwise("gabled")
    if mode == "osm_tags_only":
        rule = F.when(kind == "house", by_floors).otherwise("flat")
    else:
        low = (floors <= 2) & (height <= 8)
        rule = (
            F.when(kind == "industrial", "flat")
            .when(kind == "commercial", F.when(low, "gabled").otherwise("flat"))
            .when(kind == "apartment", F.when((floors > 3) | (height > 10), "flat").otherwise("gabled"))
            .when(kind == "house", by_floors)
            .when(area < 200, "gabled")
            .when((area < 400) & low, "gabled")
            .otherwise("flat")
        )
    return F.when(shape != "gabled", shape).otherwise(rule)


def eligibility(vertices: Column, has_holes: Column, convex: Column, rectangle_like: Column, fill: Column, aspect: Column, max_vertices: int = MAX_VERTICES) -> Column:
    """The first rule that a footprint fails, or eligible."""
    return (
        F.when(vertices < 3, "degenerate")
        .when(has_holes, "has_holes")
        .when(vertices > max_vertices, "too_many_vertices")
        .when(~convex, "not_convex")
        .when((vertices == 4) & ~rectangle_like, "not_rectangle_angles")
        .when(fill < MIN_FILL, "not_rectangular_enough")
        .when((aspect < MIN_ASPECT) | (aspect > MAX_ASPECT), "bad_aspect_ratio")
        .otherwise("eligible")
    )


def house_scale(area: Column, length: Column, width: Column, aspect: Column, limits: dict | None = None) -> Column:
    """The first size rule that fails, or ok."""
    own = {"area": HOUSE_AREA, "side": HOUSE_SIDE, "min_side": HOUSE_MIN_SIDE, "aspect": HOUSE_ASPECT} | (limits or {})
    return (
        F.when(F.least(length, width) < own["min_side"], "too_short_side")
        .when(F.greatest(length, width) > own["side"], "too_long_side")
        .when(area > own["area"], "too_large_area")
        .when(aspect > own["aspect"], "too_elongated")
        .otherwise("ok")
    )


def skeleton_candidate(eligible: Column, vertices: Column, has_holes: Column, scale: Column, floors: Column) -> Column:
    return (eligible == "too_many_vertices") & (vertices <= SKELETON_VERTICES) & ~has_holes & (scale == "ok") & (floors <= MAX_FLOORS)


def decided(asked: Column, eligible: Column, scale: Column, floors: Column) -> Column:
    """(actual_roof, fallback_reason). A hipped roof that is eligible but too large falls back with reason none."""
    fits = (eligible == "eligible") & (scale == "ok")
    reason = F.when(eligible != "eligible", eligible).when(asked == "gabled", scale).otherwise("none")
    pair = lambda roof, why: F.struct(roof.alias("actual_roof"), why.alias("fallback_reason"))
    flat, none = F.lit("flat"), F.lit("none")
    return (
        F.when(asked == "flat", pair(flat, none))
        .when(floors > MAX_FLOORS, pair(flat, F.lit("too_many_floors")))
        .when(fits, pair(asked, none))
        .otherwise(pair(flat, reason))
    )


def wall_kind(kind: Column, area: Column, actual_roof: Column) -> Column:
    high = kind.isin("apartment", "commercial") | ((kind == "other") & (area <= 200)) | ((kind == "house") & (actual_roof == "flat"))
    return F.when(high, "highrise").otherwise("plain")


def flat_bucket(seed: Column, groups: int = 6, merged: bool = False) -> Column:
    """The flat-roof group of a building, 1 to ``groups``."""
    return F.lit(1) if merged else (F.pmod(seed, F.lit(groups)) + 1).cast("int")
