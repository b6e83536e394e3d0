"""Connected components of an undirected graph by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root` (smallest node reachable) for each node of at least one edge between different nodes.

    A round takes every node's larger neighbours, then its smaller ones, to the least node it knows. Neighbour
    sets are never gathered: a round is aggregates and joins on the node, where a hub is split by Spark. Each round's
    edges, and each node's least and greatest neighbour, are tables in the shared folder, and the tables before them go.
    It ends without another round when all are stars: each node has one neighbour, or larger ones only. Edges that are
    stars to begin with take no round.
    """
    scratch, n = Scratch(edges.sparkSession), 0
    e = scratch.write("e0", edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = scratch.write(f"ends{n}", both.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")))
        least = ends.select("a", F.least("a", "lo").alias("m"))
        if not ends.agg(F.max(F.expr("lo < a AND lo < hi"))).first()[0]:
            scratch.drop(f"e{n}")
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = split_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, low, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch.write(f"e{n + 1}", small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(f"e{n}", f"ends{n}")
        n += 1
