"""Connected components of a table of links, by min-label stars over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b): the smallest node reachable. Nulls and self-links are ignored; empty links give no rows.

    Each round joins every node to the least node among its neighbours (large star) and then the nodes of each
    neighbourhood to its least one (small star), until nothing changes: rounds grow with the logarithm of a component's
    diameter. A hub's neighbours are reduced with partial aggregation, links meet their least node in an equi-join that
    Spark splits where a hub is hot, and each round is a written table.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        edges = cut(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if state[0] == state[2] and (before == state or not _chained(edges)):
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _chained(edges: DataFrame) -> bool:
    """Whether some node is both a member and a centre."""
    return bool(edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count())
