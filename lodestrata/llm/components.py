"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and sums of hashes, which are taken while they are written."""
    seen = Observation()
    counts = (F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("a"), F.sum(F.xxhash64("u", "v") % 1000003).alias("b"))
    table = materialize(edges.observe(seen, *counts), "edges")
    return table, tuple(sorted(seen.get.items()))


def connected(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, label: the least node reachable, for every node that has a link.

    Each round takes one aggregate by node (the least neighbour, combined in the tasks first) and one join; a node with
    very many neighbours is one key of a join that Spark can split. The number of rounds grows with the logarithm of
    the longest chain."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = _written(edges)
    for _ in range(most_rounds):
        # large star: larger neighbours of u point to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours, which are few by now, point to the least of them
        large = large.repartition("u")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges, now = _written(small)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
