"""Steps whose cost per row or per file was too high for large tables."""

from pyspark.sql import functions as F

from terralith.functions import kernels, rings

RING = "array<struct<x: double, y: double>>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def points(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def test_without_collinear_is_one_kernel(spark):
    square = points((0, 0), (5, 0), (10, 0), (10, 10), (0, 10))
    rows = spark.createDataFrame([(1, square), (2, points((0, 0), (1, 0), (2, 0))), (3, None)], f"k int, ring {RING}")
    found = rows.select("k", rings.without_collinear(F.col("ring")).alias("left"))
    assert "lambda" not in plan(found)
    assert {r.k: r.left and [(p.x, p.y) for p in r.left] for r in found.collect()} == {1: [(0, 0), (10, 0), (10, 10), (0, 10)], 2: [(0, 0), (1, 0), (2, 0)], 3: None}
    areas = rows.select("k", kernels.signed_area("ring").alias("a")).collect()
    assert {r.k: r.a for r in areas} == {1: 100, 2: 0, 3: None}
