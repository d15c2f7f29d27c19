"""Projection, tiles, distances and texture coordinates as column math."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and the UTM scale.
RADIUS, ECC2, SCALE = 6378137.0, 0.00669438, 0.9996
MAX_BOX_DEG2 = 0.25
PATCH_M = 5760.0


def project_utm(lat: Column, lon: Column, zone: Column, tx: Column, ty: Column) -> Column:
    """(x, y) of a point in its patch's frame: transverse Mercator, then the patch's offsets."""
    e2, ep = ECC2, ECC2 / (1 - ECC2)
    wrapped = lon - F.floor((lon + 180) / 360) * 360
    phi, a0 = F.radians(lat), F.radians(wrapped - ((zone - 1) * 6 - 177))
    n = F.lit(RADIUS) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c, a = F.pow(F.tan(phi), 2), ep * F.pow(F.cos(phi), 2), F.cos(phi) * a0
    m = RADIUS * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = SCALE * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(a, 5) / 120) + 500000
    y = SCALE * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(a, 6) / 720))
    return F.struct((x + tx).alias("x"), (y + F.when(lat < 0, 1e7).otherwise(0.0) + ty).alias("y"))


def quadkey(lat: Column, lon: Column, zoom: int = 9) -> Column:
    s = F.sin(F.radians(lat))
    n = float(1 << zoom)
    tx = F.floor((lon + 180) / 360 * n)
    ty = F.floor((0.5 - F.ln((1 + s) / (1 - s)) / (4 * F.pi())) * n)
    bit = lambda t, i: F.floor(t / F.lit(float(1 << i))).cast("bigint") % 2
    return F.concat(*[(bit(tx, i) + 2 * bit(ty, i)).cast("string") for i in range(zoom - 1, -1, -1)])


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres."""
    dy = (lat1 - lat2) * 111320.0
    dx = (lon1 - lon2) * 111320.0 * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def box_error(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Why a box is unusable; empty if it's fine."""
    return (
        F.when(~(lat_min.between(-90, 90) & lat_max.between(-90, 90)), "Latitude must be between -90 and 90")
        .when(~(lon_min.between(-180, 180) & lon_max.between(-180, 180)), "Longitude must be between -180 and 180")
        .when(lat_min >= lat_max, "lat_min must be less than lat_max")
        .when(lon_min >= lon_max, "lon_min must be less than lon_max")
        .when((lat_max - lat_min) * (lon_max - lon_min) > MAX_BOX_DEG2, "Bounding box too large")
        .otherwise("")
    )


def centre_span(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    return F.struct(((lat_min + lat_max) / 2).alias("lat"), ((lon_min + lon_max) / 2).alias("lon"), (lat_max - lat_min).alias("lat_span"), (lon_max - lon_min).alias("lon_span"))


def mosaic_offset(patch_id: Column, x0: int, y0: int) -> Column:
    """Where a patch lies in the landscape: columns run against x."""
    px, py = F.substring(patch_id, 1, 3).cast("int"), F.substring(patch_id, 4, 3).cast("int")
    return F.struct((-(px - x0) * PATCH_M).alias("dx"), ((py - y0) * PATCH_M).alias("dy"))


# Texture coordinates: six roof slices above twelve facade blocks of three sections.


def wall_u_range(width: Column) -> Column:
    """Walls take whole blocks of 3 m, at least one, starting after the door block."""
    blocks = F.greatest(F.lit(1.0), F.ceil(F.round(width / 3.0, 9)).cast("double"))
    return F.struct((F.lit(1.0) / 3).alias("u0"), (F.lit(1.0) / 3 + blocks / 3).alias("u1"))


def roof_v_range(index: Column) -> Column:
    return F.struct((1 - (index + 1) / 24).alias("v0"), (1 - index / 24).alias("v1"))


def section_number(name: Column) -> Column:
    """A facade block's sections from the top: gable, upper, ground."""
    return F.when(name == "gable", 0).when(name == "upper", 1).otherwise(2)


def facade_v_range(index: Column, section: Column) -> Column:
    """section: 0 gable, 1 upper, 2 ground, from the top of the block."""
    top = 0.75 - index / 16 - section / 48
    return F.struct((top - 1 / 48).alias("v0"), top.alias("v1"))


def highrise_v_range(region: Column) -> Column:
    return F.struct((1 - (region + 1) / 12).alias("v0"), (1 - region / 12).alias("v1"))


def highrise_u_range(width: Column) -> Column:
    """Whole blocks of 3 m, at least one, of the 24 m that the texture is wide."""
    return F.struct(F.lit(0.0).alias("u0"), (F.greatest(F.lit(1.0), F.ceil(F.round(width / 3.0, 9)).cast("double")) / 8).alias("u1"))


def highrise_part_v(region: Column, part: Column, floors: Column) -> Column:
    """The first part grows up from the ground of its region, later ones from the floor above it; a floor is a quarter of a region."""
    low = 1 - (region + 1) / 12 + F.when(part == 0, 0.0).otherwise(1.0) / 48
    return F.struct(low.alias("v0"), (low + floors / 48).alias("v1"))


def orthophoto_uv(x: Column, y: Column, flip_v: bool = False) -> Column:
    v = (y + PATCH_M / 2) / PATCH_M
    return F.struct(((x + PATCH_M / 2) / PATCH_M).alias("u"), (1 - v if flip_v else v).alias("v"))


def aligned_uv(x: Column, y: Column, cx: Column, cy: Column, degrees: Column, metres: float = 1.0) -> Column:
    """Texture coordinates along the longest edge, about the vertex mean; one unit a metre."""
    c, s = F.cos(F.radians(-degrees)), F.sin(F.radians(-degrees))
    return F.struct((((x - cx) * c - (y - cy) * s) / metres).alias("u"), (((x - cx) * s + (y - cy) * c) / metres).alias("v"))
