"""Connected components of a link table by alternating large-star and small-star rounds.

Links are rows and stay rows: a node's neighbours are never gathered in one
place, only their minimum is, by a sum that combines before it shuffles. Every
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import forget, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(neighbours: DataFrame, keep_self: bool) -> DataFrame:
    """Link every neighbour (and, for small stars, the node) to the least of the neighbourhood."""
    least = neighbours.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = neighbours.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    if keep_self:
        linked = linked.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return linked.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that ``links`` (a, b: long) names; root is the least node of the component.

    Null ends are ignored, as are links of a node to itself; an empty table gives an empty one.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        # Large star: of each node, only the greater neighbours move. Small star: only the smaller ones do.
        both = _both(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        small = _star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), keep_self=True)
        after = stored(small.select("a", "b"), "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = after
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
