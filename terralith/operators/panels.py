"""Walls and roofs as faces: rows (patch_id, osm_id, face, corners array<x, y, z, u, v>).

Faces are made inside a building's row and exploded; nothing shuffles before the
vertices are numbered. u and v are texture coordinates: walls take the facade of
their building (ground, upper, gable sections of a block), high-rise walls a region
of floors, pitched roofs a slice, flat roofs metres along the longest edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import geo, kernels, rings, tags
from terralith.operators.footprints import computed
from terralith.operators.numbering import numbered, ranked
from terralith.shared import written

SHORTEST_M, FIRST_FLOORS, MORE_FLOORS = 0.01, 4, 3
GABLE_M, OVERHANG_M, ACROSS = 3.0, 0.5, 0.3
#: Walls of floor panels have an atlas of facades alone, so what is 0 to 0.75 elsewhere is 0 to 1.
PLAIN_V_SCALE = 1 / 0.75
KEY = ["patch_id", "osm_id"]
# Texture files by group.
TEXTURES = {
    "houses": "Houses_Atlas.dds", "Highrise_walls": "Highrise_Atlas.dds", "industrial_walls": "Industrial_Atlas.dds", "flat_roof_1": "Roof1.dds", "flat_roof_2": "Roof2.dds",
    "flat_roof_3": "Roof3.dds", "flat_roof_4": "Roof4.dds", "flat_roof_5": "Roof5.dds", "flat_roof_6": "Roof6.dds", "flat_roof": "Roof1.dds", "pylones": "Pylons.dds",
    "aerialway": "Pylons.dds", "wind_turbine": "WindTurbine.dds", "chimney": "Chimney.dds",
}


def point(x: Column, y: Column, z: Column, u: Column | None = None, v: Column | None = None) -> Column:
    texture = [] if u is None else [u.alias("u"), v.alias("v")]
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), *texture)


def textured(buildings: DataFrame) -> DataFrame:
    """Adds roof_slice, facade and region, a building's choices among six roofs, twelve facades and six regions of its category."""
    region = tags.variation(F.col("seed"), 6, "region") + F.when(F.col("category") == "commercial", 6).otherwise(0)
    return computed(buildings, {"roof_slice": tags.variation(F.col("seed"), 6, "roof"), "facade": tags.variation(F.col("seed"), 12, "facade"), "region": region})


def all_edges(buildings: DataFrame) -> DataFrame:
    """One row per wall edge of the outer ring and the holes that isn't too short: adds ring_no, e, pos and len."""
    found = buildings.select("*", kernels.wall_edges("outer", "holes", F.lit(SHORTEST_M)).alias("edges"))
    return found.select("*", F.inline("edges")).drop("edges").withColumn("pos", F.col("e.pos"))


def quad(e: Column, z0: Column, z1: Column, u: Column, v: Column) -> Column:
    """A wall over an edge, from below left on; ``u`` and ``v`` are ranges (u0, u1) and (v0, v1)."""
    return F.array(
        point(e["x1"], e["y1"], z0, u["u0"], v["v0"]), point(e["x2"], e["y2"], z0, u["u1"], v["v0"]),
        point(e["x2"], e["y2"], z1, u["u1"], v["v1"]), point(e["x1"], e["y1"], z1, u["u0"], v["v1"]),
    )


def floor_panels(buildings: DataFrame) -> DataFrame:
    """A panel per edge and floor, with its section of the facade: ground, upper, then gable."""
    step = F.col("height_m") / F.col("floors")
    each = all_edges(buildings).select("*", F.explode(F.sequence(F.lit(0), F.col("floors") - 1)).alias("floor"))
    low = F.col("floor_z") + F.col("floor") * step
    section = F.when(F.col("floor") == 0, "ground").when(F.col("floor") == 1, "upper").otherwise("gable")
    own = geo.facade_v_range(F.col("facade"), geo.section_number(section))
    v = F.struct((own["v0"] * PLAIN_V_SCALE).alias("v0"), (own["v1"] * PLAIN_V_SCALE).alias("v1"))
    face = quad(F.col("e"), low, low + step, geo.wall_u_range(F.col("len")), v)
    return each.select(*KEY, "ring_no", "pos", F.col("floor").alias("part"), section.alias("section"), face.alias("corners"))


def highrise_panels(buildings: DataFrame) -> DataFrame:
    """A first panel of up to four floors, then one for each three more."""
    parts = F.greatest(F.lit(0), F.ceil((F.col("floors") - FIRST_FLOORS) / MORE_FLOORS).cast("int"))
    each = all_edges(buildings).select("*", F.explode(F.sequence(F.lit(0), parts)).alias("part"))
    step = F.col("height_m") / F.col("floors")
    below = F.when(F.col("part") == 0, 0).otherwise(FIRST_FLOORS + (F.col("part") - 1) * MORE_FLOORS)
    above = F.least(F.col("floors"), FIRST_FLOORS + F.col("part") * MORE_FLOORS)
    v = geo.highrise_part_v(F.col("region"), F.col("part"), above - below)
    face = quad(F.col("e"), F.col("floor_z") + below * step, F.col("floor_z") + above * step, geo.highrise_u_range(F.col("len")), v)
    return each.select(*KEY, "ring_no", "pos", "part", (above - below).alias("floors"), face.alias("corners"))


def _side_v() -> Column:
    """Walls of one panel: the ground section, or ground and upper in one."""
    ground, upper = (geo.facade_v_range(F.col("facade"), F.lit(k)) for k in (2, 1))
    return F.struct(ground["v0"].alias("v0"), F.when(F.col("floors") == 1, ground["v1"]).otherwise(upper["v1"]).alias("v1"))


def side_walls(buildings: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One panel per edge, from the floor to the eaves; ``key``: the building's columns that its faces bring along."""
    top = F.col("floor_z") + F.col("height_m")
    face = quad(F.col("e"), F.col("floor_z"), top, geo.wall_u_range(F.col("len")), _side_v())
    return all_edges(buildings).select(*key, "ring_no", "pos", F.lit(0).alias("part"), face.alias("corners"))


def gable_walls(buildings: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Walls under a gabled roof: ends across the ridge are pentagons up to it (a quad and a triangle on one floor), the others quads."""
    e, top = F.col("e"), F.col("floor_z") + F.col("height_m")
    along = F.abs((e["x2"] - e["x1"]) * F.cos(F.radians("axis_deg")) + (e["y2"] - e["y1"]) * F.sin(F.radians("axis_deg"))) / F.col("len")
    edges = computed(all_edges(buildings), {"end": along < ACROSS, "u": geo.wall_u_range(F.col("len")), "side": _side_v(), "gable": geo.facade_v_range(F.col("facade"), F.lit(0))})
    u, side, gable = F.col("u"), F.col("side"), F.col("gable")
    wall = quad(e, F.col("floor_z"), top, u, side)
    mid_u = (u["u0"] + u["u1"]) / 2
    apex = point((e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2, top + GABLE_M, mid_u, gable["v1"])
    triangle = F.array(point(e["x1"], e["y1"], top, u["u0"], gable["v0"]), point(e["x2"], e["y2"], top, u["u1"], gable["v0"]), apex)
    five = F.array(wall[0], wall[1], wall[2], apex, wall[3])
    faces = F.when(~F.col("end"), F.array(wall)).when(F.col("floors") == 1, F.array(wall, triangle)).otherwise(F.array(five))
    return edges.select(*key, "ring_no", "pos", F.posexplode(faces).alias("part", "corners"))


def _turned(along: Column, across: Column, z: Column, u: Column, v: Column) -> Column:
    """A point given along and across the ridge, from the box's centre."""
    c, s = F.col("axis_cos"), F.col("axis_sin")
    return point(F.col("obb.center_x") + along * c - across * s, F.col("obb.center_y") + along * s + across * c, z, u, v)


def gabled_roofs(buildings: DataFrame, overhang: float = OVERHANG_M, key: list[str] = KEY) -> DataFrame:
    """Two slopes over the oriented box; the eaves hang over and sink along the slope."""
    own = geo.roof_v_range(F.col("roof_slice"))
    half_w = F.col("obb.width") / 2
    sized = computed(
        buildings,
        {
            "axis_cos": F.cos(F.radians("axis_deg")), "axis_sin": F.sin(F.radians("axis_deg")), "half_l": F.col("obb.length") / 2 + overhang, "reach": half_w + overhang,
            "ridge": F.col("floor_z") + F.col("height_m") + GABLE_M, "drop": GABLE_M / half_w * (half_w + overhang), "v0": own["v0"], "v1": own["v1"],
        },
    )
    span, zero = 2 * F.col("half_l") / F.col("reach"), F.lit(0.0)

    def slope(side: int) -> Column:
        l, w, eave = side * F.col("half_l"), -side * F.col("reach"), F.col("ridge") - F.col("drop")
        return F.array(_turned(-l, w, eave, zero, F.col("v0")), _turned(l, w, eave, span, F.col("v0")), _turned(l, zero, F.col("ridge"), span, F.col("v1")), _turned(-l, zero, F.col("ridge"), zero, F.col("v1")))

    return sized.select(*key, F.posexplode(F.array(slope(1), slope(-1))).alias("part", "corners"))


def hipped_roofs(buildings: DataFrame, overhang: float = OVERHANG_M, key: list[str] = KEY) -> DataFrame:
    """Hips and slopes over the footprint's own four edges, or a pyramid where it is nearly square or the ridge would leave it."""
    own = geo.roof_v_range(F.col("roof_slice"))
    top = F.col("floor_z") + F.col("height_m")
    found = buildings.select(*key, kernels.hipped_faces(F.col("outer"), top, F.lit(overhang), own["v0"], own["v1"]).alias("roof"))
    return found.select(*key, F.col("roof.pyramid").alias("pyramid"), F.posexplode("roof.faces").alias("part", "corners"))


def _flat(p: Column) -> Column:
    """A point of a flat roof; texture in metres along the longest edge, about the vertex mean."""
    uv = geo.aligned_uv(p["x"], p["y"], F.col("centroid.x"), F.col("centroid.y"), F.col("axis_deg"))
    return point(p["x"], p["y"], F.col("floor_z") + F.col("height_m"), uv["u"], uv["v"])


def flat_fans(buildings: DataFrame) -> DataFrame:
    """Triangles from the vertex mean to each edge, of convex rings without holes."""
    whole = buildings.where("convex AND NOT has_holes")
    ends = lambda e: F.array(_flat(F.col("centroid")), _flat(F.struct(e["x1"].alias("x"), e["y1"].alias("y"))), _flat(F.struct(e["x2"].alias("x"), e["y2"].alias("y"))))
    return whole.select(*KEY, F.posexplode(F.transform(rings.edges(F.col("outer")), ends)).alias("part", "corners"))


def flat_polygons(buildings: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One polygon per building, with its holes, at the height of the walls: (ring_no, corners), ring 0 the outer one."""
    every = F.concat(F.array("outer"), F.col("holes"))
    return buildings.select(*key, F.posexplode(F.transform(every, lambda ring: F.transform(ring, _flat))).alias("ring_no", "corners"))


def normal(corners: Column) -> Column:
    """Twice the vector area of a face: its direction is the face's normal."""
    return kernels.face_normal(corners)


def face_area(corners: Column) -> Column:
    """The area of faces with texture coordinates."""
    return kernels.corner_sums(corners)["area"]


def fan(corners: Column) -> Column:
    """Triangles of an n-gon."""
    return F.transform(F.sequence(F.lit(1), F.size(corners) - 2), lambda i: F.array(corners[0], F.get(corners, i), F.get(corners, i + 1)))


def outward(faces: DataFrame, buildings: DataFrame) -> DataFrame:
    """Walls whose normal points into the building are reversed. Horizontal faces point up.

    Faces that bring their building's rings along (own_outer, own_holes) need no join. The nearest edge of the building's own rings decides; with outer rings
    counter-clockwise and holes clockwise an edge's outside is on its right.
    """
    own = faces if {"own_outer", "own_holes"} <= set(faces.columns) else faces.join(buildings.select(*KEY, F.col("outer").alias("own_outer"), F.col("holes").alias("own_holes")), KEY)
    met = own.select("*", normal(F.col("corners")).alias("n"), kernels.nearest_outside("corners", "own_outer", "own_holes").alias("edge"))
    flat = (F.abs(F.col("n.x")) < 1e-9) & (F.abs(F.col("n.y")) < 1e-9)
    wrong = F.when(flat, F.col("n.z") < 0).otherwise(F.col("n.x") * F.col("edge.nx") + F.col("n.y") * F.col("edge.ny") < 0)
    kept = [c for c in faces.columns[: faces.columns.index("corners")] if c not in ("own_outer", "own_holes")]
    return met.select(*kept, F.when(wrong, F.reverse("corners")).otherwise(F.col("corners")).alias("corners"), wrong.alias("reversed"))


def both_sides(faces: DataFrame) -> DataFrame:
    """Every face and its reverse."""
    return faces.withColumn("back", F.lit(False)).unionByName(faces.withColumns({"corners": F.reverse("corners"), "back": F.lit(True)}))


def one_side(faces: DataFrame) -> DataFrame:
    """The first of the faces of a building that have the same set of vertices."""
    key = F.sort_array(F.transform("corners", lambda p: F.struct(F.bround(p["x"], 4), F.bround(p["y"], 4), F.bround(p["z"], 4))))
    first = Window.partitionBy(*KEY, "vertex_set").orderBy("part", "back")
    return faces.withColumn("vertex_set", key).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("vertex_set", "nth")


def indexed_corners(faces: DataFrame, group: list[str], face: list[str], together: bool = False) -> DataFrame:
    """Corners of the faces of small groups, such as buildings: (group, face, corner, vertex_id, x, y, z, own).

    Vertices are numbered from 1 within a group by (x, y, z) at 4 decimals; ``own`` marks one row for each
    vertex, whose corner is null where no face that stays has it. Repeated corners and faces left with under 3 are
    gone. One shuffle of whole faces by group, none where the faces of a group already stand ``together``,
    as those made from a building's row do; a batch of faces is then numbered at once.
    """
    keys = list(dict.fromkeys([*group, *face]))
    rows = faces.select(*keys, "corners")
    if not together:
        rows = rows.repartition(*group).sortWithinPartitions(*group)
    schema = rows.drop("corners").schema
    for name, kind in (("corner", "integer"), ("vertex_id", "long"), ("x", "double"), ("y", "double"), ("z", "double"), ("own", "boolean")):
        schema = schema.add(name, kind)

    def numbered_(table: pa.Table) -> pa.RecordBatch:
        changed = np.zeros(table.num_rows, bool)
        for g in group:
            values = table.column(g).combine_chunks()
            changed[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        which = np.cumsum(changed)
        lists, points = kernels.rounded_corners(table.column("corners"))
        stays, owner = kernels.first_corners(lists, points), which[lists.of]
        # By group and point, those that stay before those that go.
        order = np.lexsort((~stays, *points[::-1], owner))
        new = np.ones(len(order), bool)
        new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (owner, *points)], axis=0)
        begin = np.flatnonzero(np.diff(owner[order], prepend=-1))
        nth = np.cumsum(new)
        number, own = np.empty(len(order), np.int64), np.zeros(len(order), bool)
        number[order] = nth - np.repeat(nth[begin] - 1, np.diff(np.append(begin, len(order))))
        own[order[new]] = True
        kept = np.flatnonzero(stays | own)
        of = pa.array(lists.of[kept])
        place = pa.array((np.arange(len(stays)) - lists.starts[lists.of])[kept].astype(np.int32), mask=~stays[kept])
        columns = [table.column(k).combine_chunks().take(of) for k in keys]
        return pa.RecordBatch.from_arrays([*columns, place, pa.array(number[kept]), *(pa.array(v[kept]) for v in points), pa.array(own[kept])], names=schema.names)

    def number(batches):
        """Groups go on into the next batch, so a batch's last group waits for it."""
        held: list[pa.RecordBatch] = []
        last = lambda b: tuple(b.column(g)[b.num_rows - 1].as_py() for g in group)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and tuple(batch.column(g)[0].as_py() for g in group) != last(held[-1]):
                yield numbered_(pa.Table.from_batches(held))
                held = []
            cut = batch.num_rows - 1
            end = last(batch)
            while cut > 0 and tuple(batch.column(g)[cut - 1].as_py() for g in group) == end:
                cut -= 1
            if cut:
                yield numbered_(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield numbered_(pa.Table.from_batches(held))

    return rows.mapInArrow(number, schema)


def shared_vertices(faces: DataFrame, group: list[str], face: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices, corners) at 4 decimals: vertices numbered from 1 within ``group``; repeated corners and faces left with under 3 go.

    Groups of buildings are numbered by ``indexed_corners``. Larger ones may be most of all
    corners: there corners are sifted face by face and get their points' numbers by ranges.
    """
    keys = list(dict.fromkeys([*group, *face]))
    if "osm_id" in group:
        indexed = written(indexed_corners(faces, group, face), "corners")
        return indexed.where("own").select(*group, "x", "y", "z", "vertex_id"), indexed.where("corner IS NOT NULL").select(*keys, "corner", "vertex_id")
    sifted = written(faces.select(*keys, F.inline(kernels.every_corner("corners"))), "corners")
    found = ranked(sifted, group, ["x", "y", "z"], "vertex_id")
    return found.where("own").select(*group, "x", "y", "z", "vertex_id"), found.where("corner IS NOT NULL").select(*keys, "corner", "vertex_id")


def export_offsets(counts: DataFrame) -> DataFrame:
    """(patch_id, lod, grp, n, first): where each group's numbers begin, in export order (rest, turbines, transmitters, pylons; names within)."""
    rank = F.when(F.col("grp").startswith("wind_turbine"), 1).when(F.col("grp").isin("transmitter", "transmitter_tower"), 2).when(F.col("grp") == "pylones", 3).otherwise(0)
    before = Window.partitionBy("patch_id", "lod").orderBy(rank, "grp").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)


def quality(faces: DataFrame) -> DataFrame:
    """Counts of faces with under three corners, with a repeated corner, without texture coordinates, and with corners that are no numbers."""
    judged = faces.select("patch_id", F.size("corners").alias("n"), kernels.face_faults("corners").alias("f"))
    return judged.groupBy("patch_id").agg(
        F.count("*").alias("faces"), F.count_if(F.col("n") < 3).alias("too_few"), F.count_if(F.col("f.repeated")).alias("repeated_corner"), F.count_if(F.col("f.untextured")).alias("untextured"),
    )


def bad_indices(corners: DataFrame, vertices: DataFrame, group: list[str]) -> DataFrame:
    """(group, n): corners whose vertex number no vertex of the group has."""
    known = vertices.select(*group, "vertex_id")
    return corners.join(known, [*group, "vertex_id"], "left_anti").groupBy(*group).agg(F.count("*").alias("n"))


def merged_groups(vertices: DataFrame, corners: DataFrame, into: Column, order: Column) -> tuple[DataFrame, DataFrame]:
    """(vertices, corners) of (patch_id, lod, grp) with groups put into one, its numbers following on.

    ``into`` names a group's target and ``order`` its place among those of one target; a
    group's numbers grow by what the groups before it have.
    """
    sizes = vertices.groupBy("patch_id", "lod", "grp").agg(F.count("*").alias("n")).withColumns({"into": into, "place": order})
    before = Window.partitionBy("patch_id", "lod", "into").orderBy("place", "grp").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(sizes.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).select("patch_id", "lod", "grp", "into", "shift"), "shifts")

    def moved(rows: DataFrame) -> DataFrame:
        joined = rows.join(shifts, ["patch_id", "lod", "grp"]).withColumn("vertex_id", F.col("vertex_id") + F.col("shift"))
        return joined.withColumn("was", F.col("grp")).withColumn("grp", F.col("into")).drop("into", "shift")

    return moved(vertices), moved(corners)


def numbered_for_export(vertices: DataFrame, corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and corners numbered from 1 over all groups of a patch and level of detail, in export order; a corner's texture number follows its place.

    (patch_id, lod, grp, vertex_id, ...) get ``index``; corners also ``uv_index``.
    """
    counts = vertices.groupBy("patch_id", "lod", "grp").agg(F.count("*").alias("n"))
    first = written(export_offsets(counts).select("patch_id", "lod", "grp", F.col("first").alias("first_vertex")), "offsets")
    textures = written(export_offsets(corners.groupBy("patch_id", "lod", "grp").agg(F.count("*").alias("n"))).select("patch_id", "lod", "grp", F.col("first").alias("first_uv")), "offsets")
    group = ["patch_id", "lod", "grp"]
    indexed = vertices.join(first, group).withColumn("index", F.col("vertex_id") + F.col("first_vertex") - 1).drop("first_vertex")
    nth = numbered(corners, group, ["osm_id", "ring_no", "pos", "part", "corner"], "uv_index")
    placed = nth.join(first, group).join(textures, group).withColumn("index", F.col("vertex_id") + F.col("first_vertex") - 1).withColumn("uv_index", F.col("uv_index") + F.col("first_uv") - 1)
    return indexed, placed.drop("first_vertex", "first_uv")


def texture_for(grp: Column, patch_id: Column, orthophoto: bool = False) -> Column:
    """(material, texture): groups share another's material by an alias; a merged flat roof may take the patch's orthophoto."""
    material = F.when(grp == "aerialway", "pylones").otherwise(grp)
    file = F.coalesce(*[F.when(material == name, texture) for name, texture in TEXTURES.items()])
    photo = F.concat(F.lit("t"), patch_id, F.lit(".dds"))
    return F.struct(material.alias("material"), (F.when(grp == "flat_roof", photo).otherwise(file) if orthophoto else file).alias("texture"))


def lods(buildings: DataFrame) -> DataFrame:
    """Every building at both levels of detail, with the roof's overhang."""
    return buildings.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("lod"), F.lit(o).alias("overhang")) for n, o in ((0, OVERHANG_M), (1, 0.0))])))


def exported(faces: DataFrame) -> DataFrame:
    """Corners in the axes of the target: (x, y, z) becomes (y, -x, z)."""
    return faces.withColumn("corners", F.transform("corners", lambda p: point(p["y"], -p["x"], p["z"], p["u"], p["v"])))
