"""Measures of many rings and faces at once: numpy over the offsets of Arrow lists.

Spark evaluates higher-order functions over arrays one element at a time outside
of generated code. A ring needs some twenty passes, a face six; here each is one
numpy operation over all points of a batch. Points are never turned into Python
objects. Null rings and faces give null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

REAL = T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def reals(names: str) -> T.StructType:
    """A struct of numbers by these names."""
    return struct(**dict.fromkeys(names.split(), REAL))


MEASURES = struct(
    area=REAL, outer_area=REAL, perimeter=REAL, bbox=reals("min_x min_y max_x max_y"), vertices=T.IntegerType(), convex=T.BooleanType(),
    rectangle_like=T.BooleanType(), axis_deg=REAL, centroid=reals("x y"), obb=reals("length width center_x center_y"),
)
RIGHT_ANGLE_TOLERANCE_DEG = 25.0
#: Keeps mixed sums of round numbers off the middle between two roundings.
MIX = 0.7310585786
#: Decimals of a footprint's area: a limit met exactly doesn't depend on a rotation's last bits.
AREA_DECIMALS = 9
# A hipped roof's height, when a footprint is square, how far a ridge may leave it.
HIP_HEIGHT_M, SQUARE_SHARE, RIDGE_MARGIN = 3.0, 0.15, 0.1


class Lists:
    """A list array as its flat fields and where each list begins and ends; empty lists take part as well."""

    def __init__(self, lists: pa.Array, fields: tuple[str, ...]):
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        if lists.null_count:
            offsets = np.concatenate([[0], np.cumsum(np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)))])
            flat = lists.flatten()
        else:
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.null = lists.is_null()
        self.starts, self.n = offsets[:-1] - offsets[0], np.diff(offsets)
        self.fields = [np.asarray(flat.field(f).to_numpy(zero_copy_only=False), float) for f in fields]
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(self.of))
        last = at == (self.starts + self.n - 1)[self.of]
        self.next = np.where(last, self.starts[self.of], at + 1)
        self.previous = np.where(at == self.starts[self.of], (self.starts + self.n - 1)[self.of], at - 1)

    def reduce(self, by: np.ufunc, values: np.ndarray, empty: float = 0.0) -> np.ndarray:
        """One value a list."""
        out = np.full(len(self.n), empty, values.dtype if values.dtype == bool else float)
        some = self.n > 0
        if some.any():
            out[some] = by.reduceat(values, self.starts[some])
        return out

    def sum(self, values: np.ndarray) -> np.ndarray:
        return self.reduce(np.add, values)


def _signed_areas(x: np.ndarray, y: np.ndarray, rings: Lists) -> np.ndarray:
    """About each ring's first vertex: far from the origin the products' last bits would be as large as small rings' areas allow."""
    if not len(x):
        return np.zeros(len(rings.n))
    first = np.minimum(rings.starts, len(x) - 1)[rings.of]
    x, y = x - x[first], y - y[first]
    return rings.sum(x * y[rings.next] - x[rings.next] * y) / 2


def _struct(null: pa.Array | None = None, **fields) -> pa.StructArray:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in fields.values()]
    return pa.StructArray.from_arrays(arrays, names=list(fields), mask=null)


def _hole_areas(holes: pa.Array) -> np.ndarray:
    offsets = holes.offsets.to_numpy().astype(np.int64)
    inner = holes.values.slice(offsets[0], offsets[-1] - offsets[0])
    if not len(inner):
        return np.zeros(len(holes))
    rings = Lists(inner, ("x", "y"))
    areas = np.append(0.0, np.cumsum(np.abs(_signed_areas(*rings.fields, rings))))
    return areas[offsets[1:] - offsets[0]] - areas[offsets[:-1] - offsets[0]]


@F.arrow_udf(MEASURES)
def ring_measures(outer: pa.Array, holes: pa.Array) -> pa.Array:
    """Areas, perimeter, box, vertices, convexity, right angles, direction of the first longest edge, vertex mean and the box along that direction."""
    rings = Lists(outer, ("x", "y"))
    x, y = rings.fields
    n, nxt, prv = rings.n, rings.next, rings.previous
    dx, dy = x[nxt] - x, y[nxt] - y
    length = np.sqrt(dx * dx + dy * dy)
    outer_area = np.abs(_signed_areas(x, y, rings))

    turn = (x - x[prv]) * dy - (y - y[prv]) * dx
    left, right = (rings.reduce(np.logical_or, t, False) for t in (turn >= 1e-10, turn <= -1e-10))
    convex = (n >= 3) & (left != right)

    ax, ay = x[prv] - x, y[prv] - y
    la, lb = np.sqrt(ax * ax + ay * ay), length
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip((ax * dx + ay * dy) / (la * lb), -1.0, 1.0)
        near = (la >= 1e-6) & (lb >= 1e-6) & (np.abs(np.arccos(cosine) - np.pi / 2) <= np.radians(RIGHT_ANGLE_TOLERANCE_DEG))
    rectangle = (n == 4) & rings.reduce(np.logical_and, near, True)

    longest = rings.reduce(np.maximum, length)
    at = np.where(length >= longest[rings.of] - 1e-9, np.arange(len(x)), len(x))
    first = np.minimum(rings.reduce(np.minimum, at, 0).astype(np.int64), max(len(x) - 1, 0))
    raw = np.degrees(np.arctan2(dy[first], dx[first])) if len(x) else np.zeros(len(n))
    axis = raw - np.floor(raw / 180) * 180
    c, s = np.cos(np.radians(axis)), np.sin(np.radians(axis))
    u, v = x * c[rings.of] + y * s[rings.of], y * c[rings.of] - x * s[rings.of]
    (u0, u1, v0, v1, x0, x1, y0, y1) = (rings.reduce(by, values) for values in (u, v, x, y) for by in (np.minimum, np.maximum))
    mid_u, mid_v = (u0 + u1) / 2, (v0 + v1) / 2
    many = np.maximum(n, 1)
    return _struct(
        rings.null,
        area=np.round(outer_area - _hole_areas(holes), AREA_DECIMALS), outer_area=outer_area, perimeter=rings.sum(length), bbox=_struct(min_x=x0, min_y=y0, max_x=x1, max_y=y1),
        vertices=n.astype(np.int32), convex=convex, rectangle_like=rectangle, axis_deg=axis, centroid=_struct(x=rings.sum(x) / many, y=rings.sum(y) / many),
        obb=_struct(length=u1 - u0, width=v1 - v0, center_x=mid_u * c - mid_v * s, center_y=mid_u * s + mid_v * c),
    )


def _chain(of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of points sorted by (ring, x, y) the places of each ring's lower hull, from its first to its last point.

    In rounds, all at once: a point on or above the chord of its neighbours in the chain is above a
    chord of two points of the ring, so it is no corner of the hull. When none is left the chain only turns left.
    """
    left = np.arange(len(x))
    while True:
        inner = np.zeros(len(left), bool)
        inner[1:-1] = (of[left[1:-1]] == of[left[:-2]]) & (of[left[1:-1]] == of[left[2:]])
        k = np.flatnonzero(inner)
        p, q, r = left[k - 1], left[k], left[k + 1]
        gone = k[(x[q] - x[p]) * (y[r] - y[p]) - (y[q] - y[p]) * (x[r] - x[p]) <= 0]
        if not len(gone):
            return left
        left = np.delete(left, gone)


def _hull_areas(of: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The hull's area of each of n rings, from all their points: what lies between its lower and its upper chain."""
    out = np.zeros(n)
    for sign in (1, -1):
        order = np.lexsort((sign * y, x, of))
        ring, px, py = of[order], x[order], sign * y[order]
        chain = _chain(ring, px, py)
        same = ring[chain[1:]] == ring[chain[:-1]]
        a, b = chain[:-1][same], chain[1:][same]
        out -= np.bincount(ring[a], weights=(px[b] - px[a]) * (py[a] + py[b]) / 2, minlength=n)
    return out


@F.arrow_udf(REAL)
def hull_area(outer: pa.Array) -> pa.Array:
    """The area of each ring's convex hull; rings that turn one way only are their own hull."""
    rings = Lists(outer, ("x", "y"))
    x, y = rings.fields
    out = np.abs(_signed_areas(x, y, rings))
    turn = (x - x[rings.previous]) * (y[rings.next] - y) - (y - y[rings.previous]) * (x[rings.next] - x)
    mixed = rings.reduce(np.logical_or, turn > 0, False) & rings.reduce(np.logical_or, turn < 0, False)
    if mixed.any():
        number = np.cumsum(mixed) - 1
        point = np.flatnonzero(mixed[rings.of])
        of = rings.of[point]
        first = rings.starts[of]
        out[mixed] = _hull_areas(number[of], x[point] - x[first], y[point] - y[first], int(mixed.sum()))
    return pa.array(out, mask=rings.null.to_numpy(zero_copy_only=False))


@F.arrow_udf(reals("x y z"))
def face_normal(corners: pa.Array) -> pa.Array:
    """Twice the vector area of a face (Newell): its direction is the face's normal."""
    faces = Lists(corners, ("x", "y", "z"))
    p, n = faces.fields, faces.next
    about = lambda a, b: faces.sum((p[a] - p[a][n]) * (p[b] + p[b][n]))
    return _struct(faces.null, x=about(1, 2), y=about(2, 0), z=about(0, 1))


@F.arrow_udf(reals("x y z u v mixed area"))
def corner_sums(corners: pa.Array) -> pa.Array:
    """Sums over a face's corners of x, y, z, u, v and of x z + y u + z v, and its area: what a wrong or swapped corner changes."""
    faces = Lists(corners, ("x", "y", "z", "u", "v"))
    x, y, z, u, v = faces.fields
    n = faces.next
    about = lambda a, b: faces.sum((a - a[n]) * (b + b[n]))
    area = np.sqrt(about(y, z) ** 2 + about(z, x) ** 2 + about(x, y) ** 2) / 2
    return _struct(faces.null, **{k: faces.sum(f) for k, f in zip("xyzuv", faces.fields)}, mixed=faces.sum(x * z + y * u + z * v) * MIX, area=area)


EDGE = struct(pos=T.IntegerType(), x1=REAL, y1=REAL, x2=REAL, y2=REAL)


def _ring_edges(outer: pa.Array, holes: pa.Array) -> tuple[Lists, np.ndarray, np.ndarray]:
    """(all rings, the row of each, its number in the row): the outer ring first, then the holes."""
    outer, holes = (pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a for a in (outer, holes))
    offsets = holes.offsets.to_numpy().astype(np.int64)
    inner = holes.values.slice(offsets[0], offsets[-1] - offsets[0])
    row = np.concatenate([np.arange(len(outer)), np.repeat(np.arange(len(holes)), np.diff(offsets))])
    order = np.argsort(row, kind="stable")
    row = row[order]
    every = pa.concat_arrays([outer, inner.cast(outer.type)]).take(pa.array(order)) if len(inner) else outer
    return Lists(every, ("x", "y")), row, np.arange(len(row)) - np.searchsorted(row, row)


@F.arrow_udf(T.ArrayType(struct(ring_no=T.IntegerType(), e=EDGE, len=REAL)))
def wall_edges(outer: pa.Array, holes: pa.Array, shortest: pa.Array) -> pa.Array:
    """The edges of the outer ring and the holes that aren't shorter than ``shortest``, with their ring and place."""
    rings, row, nth = _ring_edges(outer, holes)
    x, y = rings.fields
    x2, y2 = x[rings.next], y[rings.next]
    length = np.sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))
    least = np.asarray(shortest.to_numpy(zero_copy_only=False), float)
    kept = np.flatnonzero(~(length < least[row[rings.of]]))
    of = rings.of[kept]
    e = _struct(pos=(kept - rings.starts[of]).astype(np.int32), x1=x[kept], y1=y[kept], x2=x2[kept], y2=y2[kept])
    ends = np.append(0, np.cumsum(np.bincount(row[of], minlength=len(outer))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _struct(ring_no=nth[of].astype(np.int32), e=e, len=length[kept]))


@F.arrow_udf(reals("nx ny"))
def nearest_outside(corners: pa.Array, outer: pa.Array, holes: pa.Array) -> pa.Array:
    """The outside of the edge of the rings that lies nearest to the mean of a face's corners; of edges alike near, that with the least."""
    faces = Lists(corners, ("x", "y"))
    many = np.maximum(faces.n, 1)
    mx, my = (faces.sum(v) / many for v in faces.fields)
    rings, row, _ = _ring_edges(outer, holes)
    x, y = rings.fields
    of = row[rings.of]
    dx, dy = x[rings.next] - x, y[rings.next] - y
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.maximum(0.0, np.minimum(1.0, ((mx[of] - x) * dx + (my[of] - y) * dy) / (dx * dx + dy * dy)))
    ox, oy = x + t * dx - mx[of], y + t * dy - my[of]
    gap = np.round(ox * ox + oy * oy, 9)
    order = np.lexsort((-dx, dy, gap, of))
    rows, first = np.unique(of[order], return_index=True)
    nx, ny = np.full(len(faces.n), np.nan), np.full(len(faces.n), np.nan)
    nx[rows], ny[rows] = dy[order[first]], -dx[order[first]]
    return _struct(faces.null, nx=nx, ny=ny)


@F.arrow_udf(struct(repeated=T.BooleanType(), untextured=T.BooleanType()))
def face_faults(corners: pa.Array) -> pa.Array:
    """Whether a face has two corners at one point (6 decimals), and whether one lacks a texture coordinate."""
    faces = Lists(corners, ("x", "y", "z"))
    flat = pa.concat_arrays(corners.chunks).flatten() if isinstance(corners, pa.ChunkedArray) else corners.flatten()
    points = [np.round(v, 6) + 0.0 for v in faces.fields]
    order = np.lexsort((*points, faces.of))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.all([v[order][1:] == v[order][:-1] for v in (faces.of, *points)], axis=0)
    repeated = np.bincount(faces.of[order[same]], minlength=len(faces.n)) > 0
    bare = pc.or_(pc.is_null(flat.field("u")), pc.is_null(flat.field("v"))).to_numpy(zero_copy_only=False)
    return _struct(faces.null, repeated=repeated, untextured=np.bincount(faces.of[bare], minlength=len(faces.n)) > 0)


def _shoelace(x: np.ndarray, y: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The signed area of each of n rings from their points in order, about the origin."""
    size = np.bincount(of, minlength=n)
    ends = np.cumsum(size)
    at = np.arange(len(x))
    after = np.where(at == (ends - 1)[of], (ends - size)[of], at + 1) if len(x) else at
    return np.bincount(of, weights=x * y[after] - x[after] * y, minlength=n) / 2


@F.arrow_udf(T.ArrayType(reals("x y")))
def without_collinear(ring: pa.Array, smallest: pa.Array) -> pa.Array:
    """Rings less the vertices whose triangle with both original neighbours is under an area; the ring itself if fewer than three stay."""
    rings = Lists(ring, ("x", "y"))
    x, y = rings.fields
    x0, y0, x2, y2 = x[rings.previous], y[rings.previous], x[rings.next], y[rings.next]
    least = np.asarray(smallest.to_numpy(zero_copy_only=False), float)
    kept = np.abs((x0 * (y - y2) + x * (y2 - y0) + x2 * (y0 - y)) / 2) >= least[rings.of]
    few = np.bincount(rings.of[kept], minlength=len(rings.n)) < 3
    kept |= few[rings.of]
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(rings.of[kept], minlength=len(rings.n)))), pa.int32(), mask=np.append(rings.null.to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, _struct(x=x[kept], y=y[kept]))


@F.arrow_udf(REAL)
def signed_area(ring: pa.Array) -> pa.Array:
    """A ring's area, negative where it turns clockwise."""
    rings = Lists(ring, ("x", "y"))
    return pa.array(_shoelace(*rings.fields, rings.of, len(rings.n)), mask=rings.null.to_numpy(zero_copy_only=False))


FACES = T.ArrayType(T.ArrayType(reals("x y z u v")))
_NEXT, _BEFORE = np.array([1, 2, 3, 0]), np.array([3, 0, 1, 2])


class Quads:
    """Rings of four: edges, angles, and each edge's distance to where the bisectors of its ends meet."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.dx, self.dy = x[:, _NEXT] - x, y[:, _NEXT] - y
        self.length = np.hypot(self.dx, self.dy)
        px, py, both = self.dx[:, _BEFORE], self.dy[:, _BEFORE], self.length * self.length[:, _BEFORE]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine, sine = -(self.dx * px + self.dy * py) / both, -(self.dx * py - self.dy * px) / both
            self.along = (1 + cosine) / sine
            reach = self.along + self.along[:, _NEXT]
            self.distance = self.length / reach
            self.usable = (self.length >= 0.01).all(axis=1) & (sine > 0.001).all(axis=1) & (np.abs(reach) >= 0.001).all(axis=1)

    def widened(self, by: np.ndarray) -> Quads:
        """Corners moved out along the bisector of the edges' normals, so that edges move by ``by``."""
        nx, ny = self.dy / self.length, -self.dx / self.length
        bx, by_ = nx + nx[:, _BEFORE], ny + ny[:, _BEFORE]
        size = np.hypot(bx, by_)
        half = np.maximum(np.sqrt(np.maximum(1 + nx * nx[:, _BEFORE] + ny * ny[:, _BEFORE], 0) / 2), 0.1)
        return Quads(self.x + bx / size * by[:, None] / half, self.y + by_ / size * by[:, None] / half)

    def ridge(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, distance) of the point where the bisectors at the ends of one edge of each ring meet."""
        k = np.arange(len(edge)), edge
        share = self.distance[k] / self.length[k]
        return self.x[k] + share * (self.along[k] * self.dx[k] - self.dy[k]), self.y[k] + share * (self.along[k] * self.dy[k] + self.dx[k]), self.distance[k]


@F.arrow_udf(struct(pyramid=T.BooleanType(), faces=FACES))
def hipped_faces(outer: pa.Array, wall_top: pa.Array, overhang: pa.Array, v0: pa.Array, v1: pa.Array) -> pa.Array:
    """Four roof faces over each counter-clockwise ring of four: hips over the two edges whose bisectors meet nearest and
    slopes over the others, or a pyramid where the ring is nearly square or the ridge would leave it. No faces for other rings."""
    rings = Lists(outer, ("x", "y"))
    top, out, low, high = (np.asarray(a.to_numpy(zero_copy_only=False), float) for a in (wall_top, overhang, v0, v1))
    four = np.flatnonzero(rings.n == 4)
    at = rings.starts[four][:, None] + np.arange(4)
    own = Quads(rings.fields[0][at], rings.fields[1][at])
    with np.errstate(divide="ignore", invalid="ignore"):
        wide = own.widened(out[four])
        fine = own.usable & wide.usable
        own, wide, four = Quads(own.x[fine], own.y[fine]), Quads(wide.x[fine], wide.y[fine]), four[fine]
    top, out, low, high = top[four], out[four], low[four], high[four]
    d = own.distance
    pitch = np.where(d.max(axis=1, initial=0) > 0.01, HIP_HEIGHT_M / np.maximum(d.max(axis=1, initial=0), 0.01), 1.0)
    eave = top - pitch * out
    square = np.abs(d[:, 0] - d[:, 1]) / np.maximum(np.maximum(d[:, 0], d[:, 1]), 0.01) < SQUARE_SHARE
    near = np.argmin(wide.distance, axis=1) if len(four) else np.zeros(0, np.int64)
    ends = [wide.ridge((near + k) % 4) for k in (0, 2)]
    x0, x1, y0, y1 = wide.x.min(axis=1, initial=np.inf), wide.x.max(axis=1, initial=-np.inf), wide.y.min(axis=1, initial=np.inf), wide.y.max(axis=1, initial=-np.inf)
    margin = np.maximum(x1 - x0, y1 - y0) * RIDGE_MARGIN
    leaves = np.zeros(len(four), bool)
    for rx, ry, _ in ends:
        leaves |= (rx < x0 - margin) | (rx > x1 + margin) | (ry < y0 - margin) | (ry > y1 + margin)
    pyramid = square | leaves
    mid_x, mid_y = wide.x.mean(axis=1), wide.y.mean(axis=1)

    rows = np.arange(len(four))
    faces = np.zeros((len(four), 4, 4, 5))
    sizes = np.full((len(four), 4), 4)
    for k in range(4):
        edge = np.where(pyramid, k, (near + k) % 4)
        a, b = (rows, edge), (rows, (edge + 1) % 4)
        (rx, ry, reach), (sx, sy, other) = (ends[0], ends[1]) if k in (0, 3) else (ends[1], ends[0])
        length = wide.length[a]
        hip = pyramid | (k % 2 == 0)
        sizes[:, k] = np.where(hip, 3, 4)
        apex_x, apex_y = np.where(pyramid, mid_x, rx), np.where(pyramid, mid_y, ry)
        apex_z = np.where(pyramid, top + HIP_HEIGHT_M, eave + reach * pitch)
        if k % 2 == 0:
            span = np.where(reach > 0.01, length / np.maximum(reach, 0.01), 1.0)
            first, second = span / 2, span / 2
        else:
            most = np.where(np.maximum(reach, other) < 0.01, 1.0, np.maximum(reach, other))
            span = length / most
            # The slope's second corner lies below this ridge point, its first below the other one.
            first, second = span - reach / most * span / 2, other / most * span / 2
        middle = np.hypot((wide.x[a] + wide.x[b]) / 2 - mid_x, (wide.y[a] + wide.y[b]) / 2 - mid_y)
        around = np.where(middle > 0.01, length / np.maximum(middle, 0.01), 1.0)
        span = np.where(pyramid, around, span)
        faces[:, k, 0] = np.column_stack([wide.x[a], wide.y[a], eave, np.zeros(len(four)), low])
        faces[:, k, 1] = np.column_stack([wide.x[b], wide.y[b], eave, span, low])
        faces[:, k, 2] = np.column_stack([apex_x, apex_y, apex_z, np.where(pyramid, span / 2, first), high])
        faces[:, k, 3] = np.column_stack([sx, sy, eave + other * pitch, second, high])
    kept = np.arange(4) < sizes[:, :, None]
    flat = faces[kept]
    corners = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(5)], names=list("xyzuv"))
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes.ravel())), pa.int32()), corners)
    counts = np.zeros(len(rings.n), np.int64)
    counts[four] = 4
    whole = np.zeros(len(rings.n), bool)
    whole[four] = pyramid
    return _struct(pyramid=whole, faces=pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), inner))


def _inside(px: np.ndarray, py: np.ndarray, ring_of: np.ndarray, rings: Lists) -> np.ndarray:
    """Whether each point lies in its ring, by the even-odd rule."""
    n = rings.n[ring_of]
    point = np.repeat(np.arange(len(px)), n)
    e = np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rings.starts[ring_of], n)
    x, y = rings.fields
    x1, y1, x2, y2, qx, qy = x[e], y[e], x[rings.next[e]], y[rings.next[e]], px[point], py[point]
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((y1 > qy) != (y2 > qy)) & (qx < (x2 - x1) * (qy - y1) / (y2 - y1) + x1)
    return np.bincount(point, weights=crossed, minlength=len(px)) % 2 == 1


def _in_area(px: np.ndarray, py: np.ndarray, row: np.ndarray, outer: Lists, holes: pa.Array) -> np.ndarray:
    """Whether each point lies in its row's outer ring and in none of its holes."""
    kept = _inside(px, py, row, outer)
    offsets = holes.offsets.to_numpy().astype(np.int64)
    first, n = offsets[:-1] - offsets[0], np.diff(offsets)[row]
    if n.any():
        inner = Lists(holes.values.slice(offsets[0], offsets[-1] - offsets[0]), ("x", "y"))
        point = np.repeat(np.arange(len(px)), n)
        hole = np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[row], n)
        kept &= np.bincount(point, weights=_inside(px[point], py[point], hole, inner), minlength=len(px)) == 0
    return kept


@F.arrow_udf(T.ArrayType(reals("px py")))
def inside_samples(outer: pa.Array, holes: pa.Array, step: pa.Array) -> pa.Array:
    """Points each ``step`` metres over a footprint's box that lie in it and in no hole; a footprint without such points gives its box's corners and centre that do."""
    rings = Lists(outer, ("x", "y"))
    x, y = rings.fields
    x0, x1, y0, y1 = (rings.reduce(by, values) for values in (x, y) for by in (np.minimum, np.maximum))
    size = step.to_numpy(zero_copy_only=False) if len(step) else np.ones(0)
    nx, ny = (np.where(rings.n > 0, np.floor((high - low) / size + 1e-9).astype(np.int64) + 1, 0) for low, high in ((x0, x1), (y0, y1)))
    row = np.repeat(np.arange(len(rings.n)), nx * ny)
    k = np.arange(len(row)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
    px, py = x0[row] + k // np.maximum(ny[row], 1) * size[row], y0[row] + k % np.maximum(ny[row], 1) * size[row]
    kept = _in_area(px, py, row, rings, holes)
    px, py, row = px[kept], py[kept], row[kept]

    bare = np.flatnonzero((np.bincount(row, minlength=len(rings.n)) == 0) & (rings.n > 0))
    corner_x = np.column_stack([x0, x1, x1, x0, (x0 + x1) / 2])[bare].ravel()
    corner_y = np.column_stack([y0, y0, y1, y1, (y0 + y1) / 2])[bare].ravel()
    of = np.repeat(bare, 5)
    kept = _in_area(corner_x, corner_y, of, rings, holes)
    row = np.concatenate([row, of[kept]])
    order = np.argsort(row, kind="stable")
    px, py = np.concatenate([px, corner_x[kept]])[order], np.concatenate([py, corner_y[kept]])[order]
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(rings.n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _struct(px=px, py=py))


VERTEX_DECIMALS = 4
CORNERS = T.ArrayType(struct(corner=T.IntegerType(), x=REAL, y=REAL, z=REAL))


def rounded_corners(corners: pa.Array) -> tuple[Lists, list[np.ndarray]]:
    """(the faces as lists, their corners' x, y, z as vertices have them: no negative zeros)."""
    faces = Lists(corners, ("x", "y", "z"))
    return faces, [np.round(v, VERTEX_DECIMALS) + 0.0 for v in faces.fields]


def first_corners(faces: Lists, points: list[np.ndarray]) -> np.ndarray:
    """Which corners are the first of their face at their point, in faces that have three points or more."""
    order = np.lexsort((*points, faces.of))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (faces.of, *points)], axis=0)
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    return first & (np.bincount(faces.of[first], minlength=len(faces.n)) >= 3)[faces.of]


@F.arrow_udf(CORNERS)
def every_corner(corners: pa.Array) -> pa.Array:
    """Each face's corners as vertices have them, by their places in the face; the place is null where a point is repeated or its face has under three."""
    faces, points = rounded_corners(corners)
    place = (np.arange(len(faces.of)) - faces.starts[faces.of]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(place, mask=~first_corners(faces, points)), *map(pa.array, points)], names=["corner", "x", "y", "z"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(faces.n)).astype(np.int32)), flat)


def _any_inside(x: np.ndarray, y: np.ndarray, of: np.ndarray, rings: Lists) -> np.ndarray:
    """Whether any point of each row (``of``: a point's row) lies in the row's ring, by the even-odd rule."""
    n = rings.n[of]
    point = np.repeat(np.arange(len(of)), n)
    edge = np.arange(len(point)) + np.repeat(rings.starts[of] - np.cumsum(n) + n, n)
    ex, ey = rings.fields
    x1, y1, x2, y2, px, py = ex[edge], ey[edge], ex[rings.next[edge]], ey[rings.next[edge]], x[point], y[point]
    spans = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = spans & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    inside = np.bincount(point[crossed], minlength=len(of)) % 2 == 1
    return np.bincount(of[inside], minlength=len(rings.n)) > 0


@F.arrow_udf(T.BooleanType())
def rings_overlap(one: pa.Array, other: pa.Array) -> pa.Array:
    """Whether a vertex or the vertex mean of either ring lies in the other."""
    a, b = Lists(one, ("x", "y")), Lists(other, ("x", "y"))
    found = np.zeros(len(a.n), bool)
    for holder, held in ((a, b), (b, a)):
        rows = np.flatnonzero(held.n > 0)
        mean = [held.sum(v)[rows] / held.n[rows] for v in held.fields]
        points = [np.concatenate([v, m]) for v, m in zip(held.fields, mean)]
        found |= _any_inside(*points, np.concatenate([held.of, rows]), holder)
    return pa.array(found)
