"""Connected components of a graph given as links, by large-star and small-star rounds (all in joins; nothing of the
graph comes to the driver but a checksum)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of each node with a link, component being the least node it reaches; roots have no row.

    `links` has two long columns u and v; order, repeats and self links don't matter, rows with a null are ignored.
    Sums before the shuffle and joins that can be split keep a node with very many links from filling one task.
    """
    tree = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    tree, before = written(tree, "links"), None
    while True:
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            return tree.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(now)
        both = tree.union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        tree = written(small.where("u <> v").distinct(), "links")
