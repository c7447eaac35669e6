"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import anew, durable, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (or smaller) neighbours over to the least node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("low"))
    joined = near.join(least.select(anew("m_u").alias("m_u"), F.least("m_u", "low").alias("m")), F.col("u") == F.col("m_u"))
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("m_u").alias("u"), F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that is not the least of its component.

    A node that is not there is its own component. `edges` has long columns u and v; loops and nulls are ignored. The work is
    in tables: only a count and a checksum of each round reach the driver.
    Rounds grow with the logarithm of the longest path.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        new = durable(_star(_star(now, True), False), "star")
        forget(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
