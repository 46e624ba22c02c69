"""Connected components of a links table, by alternating star contractions.

Large star: every node hands its larger neighbours to the smallest node it knows.
Small star: every node hands its smaller neighbours, and itself, to the smallest
of them. Both are a partial aggregate and a join, which splits hot nodes; nothing
gathers a node's neighbours, and the driver sees two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import stage


def _handed(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) and least (u, m): each v is linked to its u's m."""
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """(u, root) for each node of links (u, v), longs; root is the smallest node of
    the component and has no row of its own. Links may repeat and go either way."""
    edges = stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join's sides are dealt by it alone and a star's centre can be split
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = stage(_handed(both.filter("v > u"), least).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        own = least.select("u", F.col("m").alias("v"))
        small = _handed(large, least).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = stage(small.unionByName(own).distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
