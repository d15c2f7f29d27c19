"""A map extract is parsed in one pass."""

import bz2
import gzip

import pytest

from terralith.sources import mapxml, readers
from tests.test_growth_rings import plan

OSM = b"""<?xml version='1.0' encoding='UTF-8'?>
<osm><bounds minlat="1"/><!-- <node id="no"/> -->
<node id=" 1 " lat="45.5" lon='x'><tag k="a" v="1"/><tag k="b" v="&lt;&#228;"/><tag k="a" v="2"/></node><tag k="stray" v="1"/>
<node id="2" lon="2" lat="1e1"/>
<way id="3"/><way id="4"><nd ref="1"/>
  <nd ref="2"/><tag k="name" v="a > b"/></way>
<relation id="5"/><relation id="6"><member type="way" ref="4"/></relation></osm>"""
WANT = {
    "node": [("1", 45.5, None, [("a", "2"), ("b", "<ä")]), ("2", 10.0, 2.0, [])],
    "way": [("3", [], []), ("4", ["1", "2"], [("name", "a > b")])],
    "relation": [("5", None, []), ("6", [("way", "4", None)], [])],
}


def found(data: bytes, kinds=mapxml.KINDS) -> dict:
    rows = [r for b in mapxml.parsed(data, "p", kinds) for r in b.to_pylist()]
    assert all(r["patch_id"] == "p" for r in rows)
    parts = {
        "node": lambda r: (r["id"], r["lat"], r["lon"], r["tags"]), "way": lambda r: (r["id"], r["refs"], r["tags"]),
        "relation": lambda r: (r["id"], r["members"] and [tuple(m[k] for k in ("type", "ref", "role")) for m in r["members"]], r["tags"]),
    }
    return {k: [parts[k](r) for r in rows if r["kind"] == k] for k in kinds}


@pytest.mark.parametrize("packed", [bytes, gzip.compress, bz2.compress])
def test_elements_of_a_file(packed, monkeypatch):
    assert found(packed(OSM)) == WANT
    assert found(packed(OSM), ("way",)) == {"way": WANT["way"]}
    monkeypatch.setattr(mapxml, "BATCH", 1)
    monkeypatch.setattr(mapxml, "CHUNK", 7)
    assert found(packed(OSM)) == WANT


def test_elements_of_a_broken_file():
    """What is whole is found; an element that can't be parsed is a row of nulls, and one without an end none."""
    assert found(b"") == found(b"no xml") == {k: [] for k in WANT}
    broken = OSM.replace(b'<!-- <node id="no"/> -->', b'<node id="9" lat=5/>') + b"<osm><way id='7'/><node id='8'"
    got = found(broken)
    assert sorted(got["node"], key=str) == sorted([*WANT["node"], (None, None, None, [])], key=str)
    assert got["way"] == [*WANT["way"], ("7", [], [])] and got["relation"] == WANT["relation"]
    assert found(OSM[: OSM.index(b"<relation")]) == WANT | {"relation": []}


def test_all_elements_come_from_one_scan(spark, tmp_path):
    for patch in ("000001", "000002"):
        (tmp_path / f"map_{patch}.osm").write_bytes(OSM)
    seen = []

    def kept(every):
        seen.append(plan(every))
        every.write.parquet(f"{tmp_path}/kept")
        return spark.read.schema(every.schema).parquet(f"{tmp_path}/kept")

    nodes, ways, relations = readers.read_map_elements(spark, f"{tmp_path}/*.osm", kept=kept)
    assert len(seen) == 1 and "xml" not in seen[0] and seen[0].count("MapInArrow") == 1
    assert [df.groupBy("patch_id").count().count() for df in (nodes, ways, relations)] == [2, 2, 2] and "MapInArrow" not in plan(nodes)
    assert sorted((r.rel_id, r.members) for r in relations.where("patch_id = '000001'").collect())[1][1][0].role == ""
