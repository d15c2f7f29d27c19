"""Columns read from map tags: categories, sizes, roofs, seeds, power lines, points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Building tags by category, roof shapes by type.
HOUSE = ["house", "detached", "semidetached_house", "semi", "terrace", "terraced_house", "farm", "farmhouse", "cabin", "bungalow", "villa", "residential", "static_caravan", "hut", "shed"]
APARTMENT = ["apartments", "apartment", "flats", "dormitory", "tower", "block", "building"]
INDUSTRIAL = ["industrial", "warehouse", "factory", "hangar", "manufacture", "storage_tank", "silo", "barn", "greenhouse", "farm_auxiliary", "digester"]
COMMERCIAL = [
    "commercial", "retail", "supermarket", "office", "hotel", "shop", "kiosk", "store", "mall", "restaurant", "cafe", "bank", "hospital", "clinic", "pharmacy", "kindergarten", "school",
    "university", "college", "public", "civic", "government", "transportation", "train_station", "parking", "service", "fire_station", "police",
]
FLAT_SHAPES = ["flat", "skillion", "lean_to"]
HIPPED_SHAPES = ["hipped", "hip", "half-hipped", "half_hipped", "pyramidal"]

FLOOR_M = 3.0
MAX_LEVELS, MAX_HEIGHT = 60, 200.0
PITCH_LOW, PITCH_HIGH, PITCH_USUAL = 30.0, 60.0, 45.0
SEED = 12345


def category(tag: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(tag, F.lit("yes"))))
    return F.when(name.isin(HOUSE), "house").when(name.isin(APARTMENT), "apartment").when(name.isin(INDUSTRIAL), "industrial").when(name.isin(COMMERCIAL), "commercial").otherwise("other")


def roof_shape(tag: Column) -> Column:
    name = F.lower(F.trim(tag))
    return F.when(name.isin(FLAT_SHAPES), "flat").when(name.isin(HIPPED_SHAPES), "hipped").otherwise("gabled")


def number(text: Column) -> Column:
    """A number as Python's float() reads it, null where it would fail."""
    plain = text.rlike(r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$")
    return F.when(plain, F.trim(text).try_cast("double"))


def whole(text: Column) -> Column:
    """A whole number as Python's int() reads it, null where it would fail."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))


def metres(text: Column) -> Column:
    return number(F.replace(text, F.lit("m"), F.lit("")))


def height(tag: Column, building_tag: Column | None = None) -> Column:
    """Metres from ``height``, or else from ``building:height``."""
    return metres(tag) if building_tag is None else F.coalesce(metres(tag), metres(building_tag))


def estimated_floors(area: Column, kind: Column) -> Column:
    return (
        F.when(kind == "industrial", 1)
        .when(kind == "apartment", F.when(area > 500, 4).when(area > 200, 3).otherwise(2))
        .when(kind == "commercial", F.when(area > 200, 2).otherwise(1))
        .when(kind == "house", 2)
        .otherwise(F.when(area > 300, 3).when(area > 100, 2).otherwise(1))
    )


def estimated_height(area: Column, kind: Column) -> Column:
    return F.when(kind == "industrial", F.lit(6.0)).otherwise(estimated_floors(area, kind) * F.lit(FLOOR_M))


def floors(levels: Column, tagged_height: Column, estimate: Column, other_levels: Column | None = None) -> Column:
    """Levels as tagged, else the estimate where no height is tagged, else the height in floors, half to even."""
    tagged = whole(levels) if other_levels is None else F.coalesce(whole(levels), whole(other_levels))
    by_height = F.greatest(F.lit(1), F.bround(tagged_height / FLOOR_M).cast("int"))
    return F.coalesce(tagged, F.when(tagged_height.isNull(), estimate), by_height)


def reconciled(tagged_height: Column, floors_: Column, area: Column, kind: Column) -> Column:
    """(floors, height_m, clamped): one size from the tags and the estimate."""
    explicit = tagged_height.isNotNull()
    guess = estimated_floors(area, kind)
    metres_ = F.when(explicit, tagged_height).when(floors_ != guess, floors_ * F.lit(FLOOR_M)).otherwise(estimated_height(area, kind))
    many = floors_ > MAX_LEVELS
    f1 = F.least(floors_, F.lit(MAX_LEVELS))
    h1 = F.when(many & ~explicit, f1 * F.lit(FLOOR_M)).otherwise(metres_)
    tall = h1 > MAX_HEIGHT
    f2 = F.when(tall, F.greatest(F.lit(1), F.least(f1, F.bround(F.lit(MAX_HEIGHT) / FLOOR_M).cast("int")))).otherwise(f1)
    return F.struct(F.greatest(F.lit(1), f2).alias("floors"), F.when(tall, F.lit(MAX_HEIGHT)).otherwise(h1).alias("height_m"), (many | tall).alias("clamped"))


def address(number: Column, street: Column, city: Column) -> Column:
    """House number, street and city, as far as tagged."""
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in (number, street, city)])


def roof_pitch(tag: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(PITCH_LOW), F.least(F.lit(PITCH_HIGH), number(tag))), F.lit(PITCH_USUAL))


def roof_direction(tag: Column) -> Column:
    """(degrees, source)"""
    d = number(tag)
    turned = d - F.floor(d / 360) * 360
    return F.struct(turned.alias("degrees"), F.when(d.isNotNull(), "osm_tag").otherwise("longest_axis_heuristic").alias("source"))


def stable_seed(osm_id: Column, seed: int = SEED) -> Column:
    """Low 31 bits of the id's SHA-256, plus the seed of the run."""
    return F.conv(F.right(F.sha2(osm_id.cast("binary"), 256), F.lit(8)), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647)) + F.lit(seed)


def variation(seed: Column, n: int, salt: str) -> Column:
    """A uniform, stable choice out of n."""
    key = F.concat(seed.cast("string"), F.lit(salt)).cast("binary")
    return F.pmod(F.conv(F.right(F.sha2(key, 256), F.lit(8)), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647)), F.lit(n)).cast("int")


def in_random_subset(seed: Column, share: float, salt: str = "subset") -> Column:
    return variation(seed, 1_000_000, salt) < int(share * 1_000_000)


# Power lines and lifts.


def voltage_kv(text: Column) -> Column:
    """The highest voltage of a list in volts, or in kV where it says so."""
    def part(p):
        low = F.lower(F.trim(p))
        kilo = F.endswith(low, F.lit("kv"))
        return F.when(kilo, F.trim(F.regexp_replace(low, "kv$", "")).try_cast("double")).otherwise(low.try_cast("double") / 1000)

    return F.array_max(F.transform(F.split(text, "[;,]"), part))


def line_class(kv: Column, power: Column, name: Column) -> Column:
    return F.when(kv >= 110, "large").when(kv >= 45, "medium").when(kv.isNotNull(), "small").when(power == "minor_line", "small").when(name.isNotNull(), "large").otherwise("medium")


def is_high_voltage(kv: Column, kind: Column) -> Column:
    return F.coalesce(kv >= 69, kind == "large")


def is_drawable(power: Column, kv: Column) -> Column:
    return power.isin("line", "minor_line") & F.coalesce(kv >= 1, F.lit(True))


# Lifts with cabins; all others have chairs.
CABIN_LIFTS = ["cable_car", "gondola"]
CHAIR_LIFTS = ["chair_lift", "drag_lift", "t-bar", "j-bar", "platter", "mixed_lift", "magic_carpet", "rope_tow", "zip_line"]


def aerialway_class(tag: Column) -> Column:
    """(line_class, pylon) of a lift."""
    cabin = tag.isin(CABIN_LIFTS)
    return F.struct(F.when(cabin, "cabin").otherwise("chair").alias("line_class"), F.when(cabin, "Pylon_AerialCab").otherwise("Pylon_Aerialway").alias("pylon"))


def is_aerialway(tag: Column) -> Column:
    return tag.isin(CABIN_LIFTS + CHAIR_LIFTS)
