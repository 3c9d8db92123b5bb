"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.shared import stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _is_stars(links: DataFrame) -> bool:
    """Whether every node of links (a, b) has one parent b or children, but neither two parents nor both."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("parents"), F.min("up").alias("child_only"))
    return nodes.where("parents > 1 OR (parents = 1 AND child_only = 0)").limit(1).count() == 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that links reach from it.

    Alternates large-star and small-star steps, as published for map-reduce: each
    joins nodes to the smallest neighbour, until every component is a star, which
    one aggregation of the nodes tells. A node's neighbours are never gathered; they
    meet in a minimum and a join. Nulls and loops are left out; without links the
    result is empty.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_stars(now):
        both = _both(now)
        # repeated rows of this step go with those of the next
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        low = _least(large)
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
