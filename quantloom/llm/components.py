"""Connected components of an edge table, by alternating star steps.

Every step is a grouped minimum (combined map-side) and a join; no neighbourhood is gathered.  The edge table of each round is checkpointed.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each larger neighbour to the smallest of the neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller end; joins the smaller neighbours and the node itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _summary(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.  Nodes without an edge don't appear; an empty edge table gives no row."""
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    before = _summary(e)
    while before[0]:
        e = checkpointed(_small_star(_large_star(e)).where("u <> v").distinct())
        after = _summary(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
