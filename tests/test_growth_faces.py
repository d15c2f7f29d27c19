"""Steps whose cost per row or per file was too high for large tables."""

import pytest

from terralith.operators import panels as pa_
from terralith.plans import panel_queries as pq
from terralith.plans import source_queries as so
from tests.test_growth_rings import RING, plan, points

SF = "/root/testdata/sf0.001"


def test_wall_edges_of_all_rings(spark):
    hole = points((2, 2), (2, 4), (4, 4))
    rows = spark.createDataFrame([(1, points((0, 0), (10, 0), (10, 0.001), (0, 10)), [hole]), (2, points((0, 0), (1, 0), (0, 1)), [])], f"k int, outer {RING}, holes array<{RING}>")
    found = pa_.all_edges(rows)
    assert "lambda" not in plan(found)
    got = sorted((r.k, r.ring_no, r.pos, r.e.x1, r.e.y1, r.e.x2, r.e.y2, round(r.len, 3)) for r in found.collect())
    assert got[:3] == [(1, 0, 0, 0, 0, 10, 0, 10), (1, 0, 2, 10, 0.001, 0, 10, 14.141), (1, 0, 3, 0, 10, 0, 0, 10)]  # the edge of a millimetre is gone
    assert [g[:3] for g in got[3:]] == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (2, 0, 0), (2, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("name", ["g9_outward", "k1_written_faces"])
def test_faces_bring_along_what_they_need(spark, name, monkeypatch):
    """Faces aren't joined with the buildings that they were made from."""
    seen = []
    monkeypatch.setattr(so.sinks, "write_faces", lambda faces, path: (seen.append(plan(faces)), faces.limit(0).write.partitionBy("patch_id", "lod", "grp").parquet(path)))
    found = (pq.Q | so.Q)[name](spark, SF)
    assert not any("Join" in p for p in seen or [plan(found)])


def test_quality_in_one_kernel(spark):
    corner = "struct<x: double, y: double, z: double, u: double, v: double>"
    c = lambda x, y, u=0.0: {"x": float(x), "y": float(y), "z": 0.0, "u": u, "v": 0.0}
    faces = [[c(0, 0), c(1, 0)], [c(0, 0), c(1, 0), c(0, 1)], [c(0, 0), c(1, 0), c(0, 1), c(-0.0, 1e-9)], [c(0, 0), c(1, 0, None), c(0, 1)]]
    found = pa_.quality(spark.createDataFrame([("p", f) for f in faces], f"patch_id string, corners array<{corner}>"))
    assert "lambda" not in plan(found) and found.first()[1:] == (4, 1, 1, 1)
