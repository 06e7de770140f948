"""Connected components of a graph of links, by alternating joins; nothing is collected but two counts a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of ``edges`` (a long, b long).

    Alternates the two star operations of Kiveris and others (2014): every node links its larger neighbours, then its
    smaller ones, to its smallest neighbour, until nothing changes; then each node has its root as only neighbour.
    """
    links = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        links = common.materialize(small)
        now = links.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
