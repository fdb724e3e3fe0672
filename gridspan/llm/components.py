"""Connected components by alternating large-star and small-star joins.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). No step holds a
component in one task: minima are pre-aggregated and hub nodes meet their minimum in a
join, whose large partitions Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (u, v) of longs to (node, root): every node that has a link to another, with
    the smallest node of its component (the smallest itself isn't listed).

    Loops and repeated links are allowed. The number of rounds is logarithmic in the
    number of nodes; each ends in a table in the shared folder.
    """
    oriented = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = staged(oriented, "links"), None
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    while (now := tuple(edges.agg(*digest).first())) != before:
        before = now
        edges = staged(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
