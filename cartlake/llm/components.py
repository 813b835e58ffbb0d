"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each linked node but the smallest of its component; ``links`` has columns a and b.

    Each step points nodes at the smallest neighbour that they know; links become stars in a number of rounds that
    grows with the logarithm of the longest path. A node with many neighbours is only ever pre-aggregated (its
    minimum) or joined to that one row, so its neighbours can be split among tasks. Links that are stars already, as
    earlier components are, need no step, so that new links may be added to them.
    """
    stars = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        stars = staged(small, "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _are_stars(links: DataFrame) -> bool:
    """Whether each node that points at a smaller one points at no other, and none points at it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("centre")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("centre")))
    found = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("centre").alias("centre"))
    return not found.where("points + centre > 1").agg(F.count("*")).first()[0]
