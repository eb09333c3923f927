"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.plans.lineage import materialize


def _down(links: DataFrame, u: str, v: str) -> DataFrame:
    """Links from the larger node (u) to the smaller (v), each once."""
    return (
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _down(both.join(least, "u").where("v > u").select("v", "m"), "v", "m")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select("v", "m").where("v > m")
    return _down(moved.unionByName(least.select(F.col("u").alias("v"), "m")), "v", "m")


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger node has one link and none is the smaller node of another."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not met.where("up > 1 OR up = 1 AND down = 1").take(1)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node of its component, also for the root itself.

    Sums and minima are combined before shuffles, joins can be split where a node
    has very many links. Every round is written, so a lost executor costs a
    re-read. Ends when all links lead from a component's nodes to its smallest one.
    `links` is read several times, so it should be a table in files.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    while True:
        links = materialize(_large_star(links), "large-star")
        links = materialize(_small_star(links), "small-star")
        if _are_stars(links):
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
