"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import kept_in_store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every linked node; the component is the smallest node reachable.

    ``links`` has the long columns u and v, in any direction, repeated or not. Every round hooks
    each node's larger neighbours, then its smaller ones, onto the smallest node it sees, until all
    links are stars around their smallest node, which takes a number of rounds that grows with the
    logarithm of a component's size. Minima are combined before they are shuffled, a node with very
    many links is an ordinary skewed join, and each round is a table in the shared folder.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = kept_in_store(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(lowest, "u")
        hooked = larger.where("far <> m").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()
        smallest = hooked.groupBy("u").agg(F.min("v").alias("m"))
        own = smallest.select("u", F.col("m").alias("v"))
        others = hooked.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept_in_store(own.unionByName(others).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
