"""Connected components of a table of links, by alternating stars.

Every round replaces links by links to smaller neighbours; the links never leave the
executors, and each round is written to the shared folder. The minimum of a node's
neighbours is aggregated before it is shuffled, so a node with very many links is no
bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v). Large: larger neighbours of u move to u's least neighbour; small: the lesser ones and u itself."""
    if large:
        near = links.select(F.col("u"), F.col("v")).union(links.select(F.col("v"), F.col("u")))
    else:
        near = links
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u")
    if large:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node that has a link, with the least node it can reach."""
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = materialise(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        shorter = materialise(_star(_star(now, True), False), "links")
        release(now)
        now = shorter
    # Now every link leads from a node to its component's least node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
