"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges by links to smaller neighbours until every node points
at its component's least node.  Rounds are DataFrame joins and aggregations cut
by durable tables; nothing is collected but whether a node is left to move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # every node tells its larger neighbours the least node it knows
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # every node tells its smaller neighbours and itself the least of them
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    told = around.join(least, "a")
    if large:
        out = told.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node points at one other, and that one at none: it is its component's least node then."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("pointed"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("pointed")))
    sums = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("pointed").alias("pointed"))
    return sums.where("points > 1 or (points = 1 and pointed = 1)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b of one orderable type)."""
    now = durable(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        then = durable(_star(_star(now, True), False), "stars")
        forget(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
