"""Connected components of a graph given by its links, as DataFrame joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import store


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in ``links`` (a, b).

    Each round links every node's larger neighbours to the smallest neighbour, then every node and its
    smaller neighbours to the smallest of these, until nothing changes; the number of rounds grows with
    the logarithm of the largest component. Links are only aggregated and joined by node, so a node with
    any number of neighbours is dealt out like the rest. Every round is written to the shared folder.
    """
    links = store(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(df):
        return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).collect()[0]

    now = state(links)
    while True:
        both = _both_ways(links)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # Now every link points from the larger id to the smaller.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(least.select("a", F.col("least").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        links = store(small, "links")
        before, now = now, state(links)
        if before == now:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
