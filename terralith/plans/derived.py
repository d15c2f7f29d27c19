"""Tables derived from the driver's tables, in Spark and as DuckDB CTEs.

All coordinates come from integer arithmetic and rational rotations. A corner
list is given once, as expressions over (a, h), and rendered for both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import tags

#: Corners (u, v) of each shape, counter-clockwise; the hole is clockwise.
RECTANGLE = [("-a", "-h"), ("a", "-h"), ("a", "h"), ("-a", "h")]
ELL = [("-a", "-h"), ("a", "-h"), ("a", "0"), ("0", "0"), ("0", "h"), ("-a", "h")]
SHEARED = [("-a", "-h"), ("a", "-h"), ("a + h", "h"), ("h - a", "h")]
HOLE = [("-a / 2", "-h / 2"), ("-a / 2", "h / 2"), ("a / 2", "h / 2"), ("a / 2", "-h / 2")]

SHAPE = "CASE WHEN k % 10 IN (7, 8) THEN 'L' WHEN k % 20 = 3 THEN 'S' ELSE 'R' END"
BASE = f"""
  SELECT CAST(k AS bigint) AS k, custkey, CAST((k * 7919) % 5760 - 2880 AS double) + shift AS cx, CAST((k * 104729) % 5760 - 2880 AS double) AS cy,
    CAST(1 + k % 17 AS double) AS a, CAST(1 + k % 11 AS double) AS h,
    CASE k % 3 WHEN 0 THEN CAST(1 AS double) WHEN 1 THEN CAST(3 AS double) / 5 ELSE CAST(5 AS double) / 13 END AS co,
    CASE k % 3 WHEN 0 THEN CAST(0 AS double) WHEN 1 THEN CAST(4 AS double) / 5 ELSE CAST(12 AS double) / 13 END AS si, {SHAPE} AS shape, k % 10 = 9 AS has_hole
"""
TAGS = """
    CASE k % 7 WHEN 0 THEN 'house' WHEN 1 THEN 'detached' WHEN 2 THEN 'apartments' WHEN 3 THEN 'warehouse' WHEN 4 THEN 'retail' WHEN 5 THEN 'yes' ELSE 'castle' END AS building_tag,
    CASE WHEN k % 997 = 0 THEN '233' WHEN k % 9 = 0 THEN NULL ELSE CAST(k % 9 AS varchar(9)) END AS levels_tag,
    CASE WHEN k % 5 = 0 THEN concat(CAST(k % 13 + 3 AS varchar(9)), ' m') END AS height_tag,
    CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'gabled' WHEN 2 THEN 'hipped' WHEN 3 THEN 'flat' WHEN 4 THEN 'pyramidal' ELSE 'onion' END AS roof_shape_tag,
    CASE WHEN k % 8 = 0 THEN CAST(k % 720 AS varchar(9)) END AS roof_direction_tag,
    CASE WHEN k % 11 = 0 THEN CAST(k % 90 AS varchar(9)) END AS roof_angle_tag
"""


def _point(u: str, v: str) -> tuple[str, str]:
    return f"cx + co * ({u}) - si * ({v})", f"cy + si * ({u}) + co * ({v})"


def _array(corners: list, spark: bool) -> str:
    points = [_point(*c) for c in corners]
    if spark:
        return "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in points) + ")"
    return "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in points) + "]"


def _outer(spark: bool) -> str:
    return f"CASE shape WHEN 'L' THEN {_array(ELL, spark)} WHEN 'S' THEN {_array(SHEARED, spark)} ELSE {_array(RECTANGLE, spark)} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition at most: what a task sorts or holds stays the same however many rows there are.
PART_ROWS = 250_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, and of at most about ``PART_ROWS`` rows: a small file gives one, and what follows computes far more than it reads."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def patch_name(key) -> F.Column:
    return F.format_string("%03d%03d", (key % 5).cast("int"), F.floor(key / 5).cast("int"))


def footprints(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """patch_id, osm_id, k, outer, holes and the tag columns; ``second``: the shifted second source."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("custkey"))
    orders = spread(orders.where("k % 3 = 0") if second else orders, "k")
    orders = orders.withColumn("shift", F.expr("CAST(k % 4 * 6 AS double)") if second else F.lit(0.0))
    fields = BASE.strip().removeprefix("SELECT")
    base = orders.selectExpr(*_split(fields)).selectExpr("*", *_split(TAGS.replace("varchar(9)", "string")))
    return base.select("*", F.expr("inline(array(struct(" + _outer(True) + " AS outer, CASE WHEN has_hole THEN array(" + _array(HOLE, True) + ") ELSE slice(array(" + _array(HOLE, True) + "), 1, 0) END AS holes)))")).select(
        patch_name(F.col("custkey") % 25).alias("patch_id"), F.col("k").cast("string").alias("osm_id"), "k", "a", "h", "shape",
        "outer", "holes",
        "building_tag", "levels_tag", "height_tag", "roof_shape_tag", "roof_direction_tag", "roof_angle_tag",
        F.when(F.col("k") % 2 == 0, tags.address((F.col("k") % 90).cast("string"), F.lit("Main Street"), F.lit(""))).alias("address"),
    )


def _split(fields: str) -> list[str]:
    """Top-level comma-separated expressions."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(fields[at:i].strip())
            at = i + 1
    return [*out, fields[at:].strip()]


#: CTEs: base (one row per footprint with its tags), fp (outer and hole lists), rv (ring vertices; ring 0 is the outer one).
FOOTPRINTS_SQL = f"""
base0 AS ({BASE} FROM (SELECT o_orderkey AS k, o_custkey AS custkey, CAST(0 AS double) AS shift FROM orders)),
base AS (SELECT *, {TAGS}, printf('%03d%03d', (custkey % 25) % 5, (custkey % 25) // 5) AS patch_id, CAST(k AS varchar) AS osm_id FROM base0),
fp AS (SELECT *, {_outer(False)} AS outer_ring, CASE WHEN has_hole THEN {_array(HOLE, False)} END AS hole FROM base),
rv0 AS (
  SELECT patch_id, osm_id, 0 AS ring_no, generate_subscripts(outer_ring, 1) - 1 AS pos, unnest(outer_ring) AS p FROM fp
  UNION ALL SELECT patch_id, osm_id, 1, generate_subscripts(hole, 1) - 1, unnest(hole) FROM fp WHERE hole IS NOT NULL
),
rv AS (SELECT patch_id, osm_id, ring_no, pos, p.x AS x, p.y AS y FROM rv0),
edges AS (
  SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2,
    coalesce(lag(x) OVER w, last_value(x) OVER f) AS x0, coalesce(lag(y) OVER w, last_value(y) OVER f) AS y0, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy
  FROM rv WINDOW w AS (PARTITION BY osm_id, ring_no ORDER BY pos), f AS (PARTITION BY osm_id, ring_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
"""

ML_SQL = FOOTPRINTS_SQL.replace("CAST(0 AS double) AS shift FROM orders", "CAST(o_orderkey % 4 * 6 AS double) AS shift FROM orders WHERE o_orderkey % 3 = 0")
