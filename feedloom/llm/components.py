"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import checkpointed


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with the smallest of u and its neighbours; counted before the join, so a hub's edges
    meet its one smallest neighbour in a join that can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): for each end of the edges (a, b), the smallest end in its component. Loops alone give no rows.

    Each round reads the last round's checkpoint; it stops when the edges stay the same, then all are stars.
    Only two numbers of each round reach the driver.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = _with_least(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
