"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import durable


def _to_minimum(links: DataFrame) -> DataFrame:
    """links (u, v) with the smallest of u and its v's as m.

    The minimum is taken before the shuffle and written, so that the join has two plain exchanges: the links of a hub are
    split over tasks by adaptive execution.
    """
    least = durable(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return links.join(least.hint("merge"), "u")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of edges (a, b: long); nodes without links are absent.

    Each half-round hangs neighbours on a node's minimum (Kiveris et al., 2014); it ends when all links are stars. Null
    ends and loops are ignored, repeated links count once, no links give no rows.
    """
    pairs = edges.where("a != b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    pairs = durable(pairs, "links")
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _to_minimum(durable(large, "links"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = durable(small.where("u != v").distinct(), "links")
        crowded = pairs.groupBy("u").count().where("count > 1").select("u")
        if crowded.isEmpty() and pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
