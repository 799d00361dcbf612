"""Connected classes of nodes, and what can be reached from given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that has one: root is the smallest node that it is connected with.

    Each round hangs every node's larger neighbours, then the node and its smaller ones, below the smallest neighbour, until
    each class is a star. The smallest neighbours are written before they are joined, so a node with very many links can
    be split by the join; a round is two joins over the links, and rounds grow with the logarithm of a class's width.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    stars = links.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def reachable(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(url, depth): what links (source, target) lead to from seeds (url) in at most depth steps, with the least number of them.

    A frontier at a time: what is new is joined to the links once, and written with its depth, so no step is computed again
    and the cost follows the links of what is reached. The frontier is made distinct before it is joined, and both sides
    of each join come straight from a shuffle, so the links of a hub are split.
    """
    edges = written(links.filter("source is not null and target is not null").select("source", "target").distinct())
    frontier = written(seeds.filter("url is not null").select("url").distinct())
    levels, seen = [frontier.withColumn("depth", F.lit(0))], frontier
    for step in range(1, depth + 1):
        found = frontier.join(edges, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct()
        frontier = written(found.join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(step)))
        seen = written(seen.unionByName(frontier)) if step % 8 == 0 else seen.unionByName(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.withColumn("depth", F.col("depth").cast("int"))
