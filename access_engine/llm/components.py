"""Connected components by joins and aggregates: every node gets the smallest node it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from access_engine.storage import drop, store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of (a, b), unordered links between longs or between strings.

    Large-star and small-star rounds: each moves links nearer to the smallest node and never adds any, so a node with
    very many links stays a list of rows that joins and combined aggregates deal with. Each round is a written table.
    """
    spark = edges.sparkSession
    now, path = store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "links")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: every smaller neighbour, and the node itself, is linked to its smallest neighbour.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(low.select("m", "b"))
        small = small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new, new_path = store(small, "links")
        # Stars only: no node is both a centre and a leaf, and no leaf has two centres.
        ends = new.groupBy("b").count().where("count > 1").select("b")
        done = ends.isEmpty() and new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        drop(spark, path)
        now, path = new, new_path
        if done:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
