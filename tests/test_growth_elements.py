"""Steps whose cost per row or per file was too high for large tables."""

from terralith.operators import elements as el
from tests.test_growth_rings import plan


def test_relations_are_stitched_in_batches_and_once(spark):
    """No group of its own in Python for each relation, and no second stitching for its holes."""
    square = {"a": (0.0, 0.0), "b": (10.0, 0.0), "c": (10.0, 10.0), "d": (0.0, 10.0), "e": (2.0, 2.0), "f": (4.0, 2.0), "g": (4.0, 4.0)}
    nodes = spark.createDataFrame([("p", k, y, x) for k, (x, y) in square.items()], "patch_id string, node_id string, lat double, lon double")
    ways = spark.createDataFrame([("p", "w1", ["a", "b", "c"]), ("p", "w2", ["a", "d", "c"]), ("p", "w3", ["e", "f", "g", "e"]), ("p", "w4", ["a", "b"])], "patch_id string, way_id string, refs array<string>")
    member = lambda ref, role: {"type": "way", "ref": ref, "role": role}
    tags = {"type": "multipolygon"}
    relations = spark.createDataFrame([("p", "r|1", [member("w1", ""), member("w3", "inner"), member("w2", "outer")], tags), ("p", "open", [member("w4", "outer")], tags)],
        "patch_id string, rel_id string, members array<struct<type: string, ref: string, role: string>>, tags map<string,string>")
    found = el.relation_polygons(relations, ways, nodes)
    text = plan(found)
    assert "FlatMapGroupsInArrow" not in text and text.count("_stitch") <= 4
    row, = found.collect()
    assert row.rel_id == "r|1" and [(p.x, p.y) for p in row.outer] == [(0, 0), (10, 0), (10, 10), (0, 10)] and [[(p.x, p.y) for p in h] for h in row.holes] == [[(4, 4), (4, 2), (2, 2)]]
