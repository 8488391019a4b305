"""Connected components of links between keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.session import materialised


def linked_groups(links: DataFrame) -> DataFrame:
    """(key, root) for every key of ``links`` (a, b): the smallest key that can be reached.

    Each round a key takes the smallest root among its neighbours' and then that root's own root, so the rounds
    grow with the logarithm of a chain's length. Neighbours are never gathered: every round is a minimum per key.
    """
    links = links.where("a <> b")
    both = materialised(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = materialised(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "key"))
    while True:
        near = both.join(roots, F.col("b") == F.col("key")).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, F.col("key") == F.col("a")).select("key", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        onward = roots.select(F.col("key").alias("_key"), F.col("root").alias("_root"))
        after = lower.join(onward, F.col("root") == F.col("_key"), "left").select("key", "before", F.least("root", "_root").alias("root"))
        after = materialised(after)
        roots = after.select("key", "root")
        if after.where("root <> before").isEmpty():
            return roots
