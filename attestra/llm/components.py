"""Connected components of a table of links, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, root the smallest node that it reaches.

    Alternates large-star and small-star steps until the links are stars around their smallest nodes. Each step takes
    a minimum by node, summed up before the shuffle, and a join that Spark may split where one node has many links.
    Lineage is cut with checkpoint() in each round. Nothing but a count and a checksum reaches the driver. Rounds go on
    until nothing changes, which the steps reach for any links. Links from a node to itself and repeated links count for nothing;
    no links give no rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
