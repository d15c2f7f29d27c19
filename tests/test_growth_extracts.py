"""Steps whose cost per row or per file was too high for large tables."""

import glob

from terralith.plans import source_queries as so
from terralith.sources import readers
from terralith.streaming import increments


def test_a_large_extract_is_several_whole_files(spark, tmp_path):
    lines = [(p, f'<node id="{p}{k}" lat="1.0" lon="2.0"/>', 0) for p, n in (("000001", 95), ("000002", 3)) for k in range(n)]
    so.by_extract(spark.createDataFrame(lines, "patch_id string, value string, kind int"), f"{tmp_path}/x", 10)
    for patch, n, files in (("000001", 95, 10), ("000002", 3, 1)):
        found = [open(f).read().split("\n")[:-1] for f in glob.glob(f"{tmp_path}/x/patch_id={patch}/*.txt")]
        assert len(found) == files and sum(len(f) - 2 for f in found) == n
        assert all(f[0] == "<osm>" and f[-1] == "</osm>" and "<osm>" not in f[1:] for f in found)
    nodes, _, _ = readers.read_map_elements(spark, f"{tmp_path}/x/*/*")
    assert {r.patch_id: r["count"] for r in nodes.groupBy("patch_id").count().collect()} == {"000001": 95, "000002": 3}


def test_a_batch_parses_its_extracts_once(spark, tmp_path, monkeypatch):
    calls = []
    read = increments.read_map_elements
    monkeypatch.setattr(increments, "read_map_elements", lambda *a, **k: (calls.append(a[1]), read(*a, **k))[1])
    (tmp_path / "in/v1/000001").mkdir(parents=True)
    (tmp_path / "in/v1/000001/a.osm").write_text('<osm>\n<node id="n" lat="1.0" lon="2.0"/>\n</osm>\n')
    none = "patch_id string, name string, length_m double, lat double, lon double, source string"
    found = increments.Increments(spark, f"file://{tmp_path}/out", lambda n, w, r: n.select("patch_id", "node_id"), lambda n, w, r: spark.createDataFrame([], none))
    found.apply(spark.createDataFrame([(f"file://{tmp_path}/in/v1/000001/a.osm",)], "path string"), 0)
    assert len(calls) == 1
    assert [tuple(r) for r in found.current("node_id string, patch_id string, version long").select("node_id", "patch_id", "version").collect()] == [("n", "000001", 1)]
