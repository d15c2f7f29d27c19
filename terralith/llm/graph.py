"""Connected components of a table of links, by alternating large and small stars.

Every round is two joins and two aggregations whose keys are nodes; partial
aggregation and adaptive skew splitting carry hubs. Rounds are written to the
shared folder, so a lost executor costs a round's tasks and plans stay short.
The number of rounds grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, go to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("of"), "m")
    moved = links.join(least, F.col("b") == F.col("of")).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("of").alias("b"))).distinct()


def _sum(links: DataFrame):
    return links.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b with a < b): root is the smallest node it reaches."""
    now, before = written(links.select("a", "b").distinct(), "links"), None
    found = _sum(now)
    while found != before and found[0]:
        now, before = written(_small_star(_large_star(now)), "star"), found
        found = _sum(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
