"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import save


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and itself, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """For links (a, b) between numbers: node, root, where root is the least number of the node's component.

    Links to oneself and repeated links are allowed. Each round is written to the shared folder, so lineage stays short;
    the number of rounds grows with the logarithm of the longest path. Minima are pre-aggregated, so a node with very many
    links costs no more than its share of rows.
    """
    now = save(links.select("a", "b").filter("a <> b").distinct(), name)
    while True:
        # the state is settled when every link leads from a node to a root that itself has no link down
        after = save(_small_star(_large_star(now).distinct()).filter("a <> b").distinct(), name)
        roots = after.select("b").distinct()
        if after.join(roots.withColumnRenamed("b", "a"), "a", "left_semi").isEmpty() and after.groupBy("a").count().filter("count > 1").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
        now = after
