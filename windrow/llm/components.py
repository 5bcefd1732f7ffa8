"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.frames import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node in ``links`` (``a, b``).

    Each round gives every node's larger neighbours, then its smaller ones, the smallest node it
    knows. Smallest nodes are aggregated before the shuffle and joined back, so a node with many
    links is no single group. Links are written each round; rounds grow with the logarithm of a
    component. Links of a node with itself and repeated links do no harm.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        found = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (edges, large):
            dropped(old)
        edges = small
        if found == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = found
