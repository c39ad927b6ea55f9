"""Connected components of a link table, as alternating star contractions in Spark.

Every round is written to the shared scratch folder, so a lost executor costs at most one round.
A node's links are reduced with ``min`` before they meet; the joins are ordinary equi-joins, which
AQE splits where one node has most of the links.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.strategies import materialize


def _star(pairs: DataFrame, keep) -> DataFrame:
    """pairs (u, v): link the kept neighbours of u with the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.where(keep).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the component's smallest node (bigint).

    NULL ends and self-links are ignored; repeated links count once; an empty table gives an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("u > v").distinct()
        # small star: the smaller neighbours of u and u itself are linked with the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "links")
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
