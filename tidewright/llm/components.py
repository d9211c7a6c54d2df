"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable id of every id with an edge: (id, component_id).

    ``edges`` has longs a and b. Each round replaces the edges by stars: first every larger neighbour is
    linked to the smallest of the neighbourhood, then every smaller one, which keeps connectivity and
    ends after a number of rounds logarithmic in practice. Nothing but two sums comes to the driver.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        old = now
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Smallest ids are written first: both sides of a join are then plain shuffles, and Spark can split
        # the one partition that holds a hub's edges.
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.where("a <> b").distinct(), "large")
        fewest = scratch.keep(large.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "smaller")
        small = large.join(fewest, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        now = scratch.keep(small.union(own).distinct(), "edges")
        for table in (old, least, large, fewest):
            scratch.drop(table)
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component_id"))
    return ids.union(roots)
