"""Connected components of a graph that lies in a DataFrame of links.

The smallest neighbours are written down before they are joined to the links, so both sides of each join come straight
from a shuffle and Spark can split the partition of a node that a large class is linked to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    least = cut(links.groupBy("a").agg(F.min("b").alias("m")))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node that can be reached.

    links has columns a and b of one orderable type; order within a pair, repeated pairs and loops don't matter; nulls
    are ignored. Alternates large and small stars until the links no longer change; every round is a few joins and
    grouped minima over the links, written to the shared folder.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(links)
    while before[0]:
        links = cut(_small_star(_large_star(links)))
        now = mark(links)
        if now == before:
            break
        before = now
    roots = links.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
