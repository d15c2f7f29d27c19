"""The export holds one share of the patches at a time, and numbers points without joins on them."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from terralith.operators import panels as pa
from terralith.operators.numbering import ranked
from terralith.plans import panel_queries as pq
from terralith.shared import CLEANED, scratch, written
from tests.test_growth_rings import plan

SF = "/root/testdata/sf0.001"


def test_alike_rows_share_a_number(spark):
    rng, nan = random.Random(5), float("nan")
    rows = [(rng.choice("aaab"), rng.choice([1.5, 2.5, -3.0, 0.0, nan, float(rng.randrange(50))]), k) for k in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = ranked(spark.createDataFrame(rows, "g string, v double, k int").repartition(3), ["g"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    value = lambda v: 1e9 if v != v else v
    want = {g: {v: n for n, v in enumerate(sorted({value(v) for h, v, _ in rows if h == g}), 1)} for g in "ab"}
    assert len(found) == len(rows) and all(r.nth == want[r.g][value(r.v)] for r in found)
    assert sorted((r.g, r.nth) for r in found if r.own) == sorted((g, n) for g in want for n in want[g].values())


def test_corners_of_large_groups_are_numbered_without_a_join_on_points(spark):
    """Vertices of faces that go stay; of large groups no table of distinct points meets the corners."""
    rows = [("p", "b", 0, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]), ("p", "b", 1, [(0.0, 0.0, 0.0), (1.00004, 0.0, 0.0), (1.0, 0.0, 0.0)]), ("p", "c", 0, [(1.0, 1.0, 0.0), (0.0, 5.0, 0.0), (0.0, 5.0, 0.0)])]
    faces = spark.createDataFrame(rows, "patch_id string, osm_id string, part int, corners array<struct<x:double,y:double,z:double>>")
    vertices, corners = pa.shared_vertices(faces, ["patch_id"], ["osm_id", "part"])
    assert sorted((r.vertex_id, r.x, r.y) for r in vertices.collect()) == [(1, 0.0, 0.0), (2, 0.0, 5.0), (3, 1.0, 0.0), (4, 1.0, 1.0)]
    assert sorted((r.osm_id, r.part, r.corner, r.vertex_id) for r in corners.collect()) == [("b", 0, 0, 1), ("b", 0, 1, 3), ("b", 0, 2, 4)]
    assert "SortMergeJoin" not in plan(corners)


def test_tables_of_a_share_are_gone_after_it(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there = lambda: sorted(f.name.split("-")[1] for f in root.glob("terralith-*") if f.name not in before)
    before = {f.name for f in root.glob("terralith-*")}
    with scratch(spark):
        assert written(spark.range(3), "one").count() == 3 and there() == ["one"]
    assert there() == [] and spark.conf.get(CLEANED) == "false"
    assert written(spark.range(3), "two").count() == 3 and there() == ["two"]
    found = pq.e3_k2_merged_export(spark, SF)
    assert there() == ["export", "two"] and found.count() > 25


def test_shares_of_patches_give_the_same_export(spark, monkeypatch):
    buildings = spark.createDataFrame([("a", 3), ("b", 3), ("c", 9), ("d", 1)], "patch_id string, n int").select("patch_id", F.explode(F.sequence(F.lit(1), "n")))
    assert pq.patch_shares(buildings, 6) == [["a", "b"], ["c"], ["d"]] and pq.patch_shares(buildings.limit(0), 6) == []
    whole = sorted(map(tuple, pq.e3_k2_merged_export(spark, SF).collect()))
    monkeypatch.setattr(pq, "patch_shares", lambda rows: [[r.patch_id for r in rows.select("patch_id").distinct().collect() if (r.patch_id < "002") == low] for low in (True, False)])
    assert sorted(map(tuple, pq.e3_k2_merged_export(spark, SF).collect())) == whole
