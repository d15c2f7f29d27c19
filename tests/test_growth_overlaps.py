"""Overlaps and floors where many buildings lie over each other: neither pairs nor a task's buildings grow with them unboundedly."""

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from terralith.functions import kernels
from terralith.operators import places, terrain


def square(x, y, side=10.0):
    return [{"x": x, "y": y}, {"x": x + side, "y": y}, {"x": x + side, "y": y + side}, {"x": x, "y": y + side}]


def test_overlaps_don_t_test_all_pairs(spark, tmp_path, monkeypatch):
    real, path = kernels.rings_overlap.func, str(tmp_path)

    @F.arrow_udf("boolean")
    def counted(one: pa.Array, other: pa.Array) -> pa.Array:
        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(one)))
        return real(one, other)

    monkeypatch.setattr(kernels, "rings_overlap", counted)
    schema = "patch_id string, osm_id string, outer array<struct<x: double, y: double>>"
    # 300 over each other, and one that only the last of its cell would meet: a small one beside 60.
    base = [("000000", str(i), square(100.0, 100.0)) for i in range(300)] + [("000000", f"n{i}", square(210.0, 210.0, 5.0)) for i in range(60)] + [("000000", "far", square(230.0, 230.0, 5.0))]
    other = [("000000", f"m{i}", square(103.0, 103.0)) for i in range(300)] + [("000000", "mfar", square(231.0, 231.0, 5.0)), ("000000", "alone", square(300.0, 300.0)), ("000001", "elsewhere", square(100.0, 100.0))]
    found = places.overlapping(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema)).collect()
    assert sorted(r.other_id for r in found) == sorted([f"m{i}" for i in range(300)] + ["mfar"])
    tested = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert 301 <= tested < 300 * 10


def test_floors_take_a_block_in_pieces(spark, tmp_path, monkeypatch):
    real, path = terrain._block_floors, str(tmp_path)

    def counted(*how):
        inner = real(*how)

        def in_block(key, buildings, triangles):
            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(buildings.num_rows))
            return inner(key, buildings, triangles)

        return in_block

    monkeypatch.setattr(terrain, "_block_floors", counted)
    ring = "array<struct<x: double, y: double>>"
    rows = [("000000", str(i), square(float(i % 20) * 10, float(i % 7) * 10), []) for i in range(300)] + [("000000", "none", [], []), ("000000", "null", None, None)]
    buildings = spark.createDataFrame(rows, f"patch_id string, osm_id string, outer {ring}, holes array<{ring}>")
    corner = lambda k, x, y: {f"x{k}": x, f"y{k}": y, f"z{k}": x / 10 + y}
    two = [{"patch_id": "000000", "tri": t, **corner(1, 0.0, 0.0), **corner(2, *b), **corner(3, *c)} for t, b, c in ((0, (250.0, 0.0), (250.0, 250.0)), (1, (250.0, 250.0), (0.0, 250.0)))]
    triangles = spark.createDataFrame(two, "patch_id string, tri long, " + ", ".join(f"{a}{k} double" for k in (1, 2, 3) for a in "xyz"))
    whole = {tuple(r) for r in terrain.floors(buildings, triangles, size=250.0).collect()}
    assert len(whole) == 302 and sum(r[3] > 0 for r in whole) > 290
    for p in tmp_path.iterdir():
        p.unlink()
    assert {tuple(r) for r in terrain.floors(buildings, triangles, size=250.0, piece=20).collect()} == whole
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) < 60
