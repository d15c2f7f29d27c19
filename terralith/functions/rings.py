"""Measures of a ring, an array of points (x, y) without a closing repeat.

All are column expressions over arrays: a ring is measured inside its row, so no
shuffle and no window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.functions import kernels


def zero() -> Column:
    return F.lit(0.0)


def at(ring: Column, index: Column) -> Column:
    """The point at a circular, zero-based index."""
    return F.get(ring, F.pmod(index, F.size(ring)).cast("int"))


def edges(ring: Column) -> Column:
    """(pos, x1, y1, x2, y2) of each edge, the closing one included."""
    def edge(p, i):
        q = at(ring, i + 1)
        return F.struct(i.alias("pos"), p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.transform(ring, edge)


def triples(ring: Column) -> Column:
    """(pos, x0, y0, x1, y1, x2, y2): each vertex with both neighbours."""
    def triple(p, i):
        o, q = at(ring, i - 1), at(ring, i + 1)
        return F.struct(i.alias("pos"), o["x"].alias("x0"), o["y"].alias("y0"), p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.transform(ring, triple)


def total(items: Column, term) -> Column:
    return F.aggregate(items, zero(), lambda acc, e: acc + term(e))


def signed_area(ring: Column) -> Column:
    return total(edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def area(outer: Column, holes: Column) -> Column:
    """Area of the outer ring minus the holes'."""
    return F.abs(signed_area(outer)) - F.aggregate(holes, zero(), lambda acc, h: acc + F.abs(signed_area(h)))


def length(e: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    return F.sqrt(dx * dx + dy * dy)


def perimeter(ring: Column) -> Column:
    return total(edges(ring), length)


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def vertex_mean(ring: Column) -> Column:
    """Mean of the vertices, each once."""
    n = F.size(ring)
    return F.struct((total(ring, lambda p: p["x"]) / n).alias("x"), (total(ring, lambda p: p["y"]) / n).alias("y"))


def closed_mean(ring: Column) -> Column:
    """Mean of the vertices with the first one counted again, as a closed way lists it."""
    n = F.size(ring) + 1
    first = F.get(ring, F.lit(0))
    return F.struct(((total(ring, lambda p: p["x"]) + first["x"]) / n).alias("x"), ((total(ring, lambda p: p["y"]) + first["y"]) / n).alias("y"))


def is_convex(ring: Column) -> Column:
    """Whether all turns that aren't straight go the same way."""
    def turn(t):
        return (t["x1"] - t["x0"]) * (t["y2"] - t["y1"]) - (t["y1"] - t["y0"]) * (t["x2"] - t["x1"])

    turns = F.filter(F.transform(triples(ring), turn), lambda c: F.abs(c) >= 1e-10)
    return (F.size(ring) >= 3) & (F.size(turns) > 0) & (F.forall(turns, lambda c: c > 0) | F.forall(turns, lambda c: c < 0))


def longest_edge_angle(ring: Column) -> Column:
    """Direction, in degrees modulo 180, of the first longest edge."""
    first = F.reduce(
        edges(ring),
        F.struct(F.lit(-1.0).alias("len"), zero().alias("angle")),
        lambda best, e: F.when(length(e) > best["len"] + 1e-9, F.struct(length(e).alias("len"), F.degrees(F.atan2(e["y2"] - e["y1"], e["x2"] - e["x1"])).alias("angle"))).otherwise(best),
    )
    degrees = first["angle"]
    return degrees - F.floor(degrees / 180) * 180


def oriented_box(ring: Column, degrees: Column) -> Column:
    """length (along the angle), width and centre of the box around the ring turned to an angle."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    along = F.transform(ring, lambda p: p["x"] * c + p["y"] * s)
    across = F.transform(ring, lambda p: p["y"] * c - p["x"] * s)
    mid_u, mid_v = (F.array_min(along) + F.array_max(along)) / 2, (F.array_min(across) + F.array_max(across)) / 2
    return F.struct(
        (F.array_max(along) - F.array_min(along)).alias("length"), (F.array_max(across) - F.array_min(across)).alias("width"),
        (mid_u * c - mid_v * s).alias("center_x"), (mid_u * s + mid_v * c).alias("center_y"),
    )


def is_rectangle_like(ring: Column, tolerance_deg: float = 25.0) -> Column:
    """Whether a ring of four vertices has all angles within the tolerance of a right one."""
    def near_right(t):
        ax, ay, bx, by = t["x0"] - t["x1"], t["y0"] - t["y1"], t["x2"] - t["x1"], t["y2"] - t["y1"]
        la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (la * lb)))
        return F.when((la < 1e-6) | (lb < 1e-6), F.lit(False)).otherwise(F.abs(F.acos(cosine) - F.pi() / 2) <= F.radians(F.lit(tolerance_deg)))

    return (F.size(ring) == 4) & F.forall(triples(ring), near_right)


def without_collinear(ring: Column, smallest: float = 0.01) -> Column:
    """One pass that drops vertices whose triangle with both original neighbours is under the given area; the ring itself if fewer than three stay."""
    return kernels.without_collinear(ring, F.lit(smallest))


def wound(ring: Column, counter_clockwise: bool = True) -> Column:
    """The ring in the wanted sense of rotation."""
    wrong = signed_area(ring) < 0 if counter_clockwise else signed_area(ring) > 0
    return F.when(wrong, F.reverse(ring)).otherwise(ring)


def closed(ring: Column) -> Column:
    """The ring with its first point repeated at the end, if it isn't already."""
    first = F.slice(ring, 1, 1)
    return F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, first))


def longest_diagonal(ring: Column) -> Column:
    """The greatest distance between two vertices."""
    def far(p):
        return F.array_max(F.transform(ring, lambda q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))))

    return F.array_max(F.transform(ring, far))


def _crossings(ring: Column, x: Column, y: Column) -> Column:
    def crossed(e):
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(edges(ring), crossed))


def inside_even_odd(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; what lies on an edge may fall on either side."""
    return F.pmod(_crossings(ring, x, y), F.lit(2)) == 1


def inside_or_on_edge(ring: Column, x: Column, y: Column, slack: float = 1e-9) -> Column:
    """Even-odd rule, with points on an edge inside."""
    def on(e):
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return (F.abs(cross) <= slack) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(edges(ring), on) | inside_even_odd(ring, x, y)


def inside_winding(ring: Column, x: Column, y: Column) -> Column:
    """Whether the ring winds round the point."""
    def turn(e):
        left = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])
        return F.when((e["y1"] <= y) & (e["y2"] > y) & (left > 0), 1).when((e["y1"] > y) & (e["y2"] <= y) & (left < 0), -1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda acc, e: acc + turn(e)) != 0
