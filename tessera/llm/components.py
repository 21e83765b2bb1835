"""Connected components of an edge table, by contraction.

Every node moves to the smallest node of its closed neighbourhood, edges are
rewritten to the moved ends and repeated edges dropped, until no edge is left.
Each round is joins and partially aggregated groupings of (u, v) rows; nothing
but a row count reaches the driver, and each round's tables are checkpointed in
the shared folder. Labels of content hashes are as good as random, so the edges
shrink geometrically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge table (u, v); the component is
    one of its nodes. Loops and repeated edges are allowed; null ends are not."""
    edges = checkpointed(edges.select("u", "v").where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    while edges.count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        left = moved.select(F.col("u").alias("a"), F.col("m").alias("ma"))
        right = moved.select(F.col("u").alias("b"), F.col("m").alias("mb"))
        labels = labels.join(left, F.col("component") == F.col("a"), "left").select(
            "node", F.coalesce("ma", "component").alias("component"))
        labels = checkpointed(labels)
        edges = edges.join(left, F.col("u") == F.col("a")).join(right, F.col("v") == F.col("b")).where("ma <> mb")
        edges = checkpointed(edges.select(F.least("ma", "mb").alias("u"), F.greatest("ma", "mb").alias("v")).distinct())
    return labels
