"""Connected components of an edge table, by alternating large-star and small-star steps; nothing leaves Spark but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.llm.common import written


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets an edge to the node's smallest neighbour (or the node itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, get an edge to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, F.col("a") == F.col("u")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; the root is the component's smallest node and has a row too.

    ``edges`` has two long columns a and b, in any order. Steps repeat until the table of edges no longer changes; each is written.
    A node may have any number of edges: minima are partial aggregates, and the join back is one that Spark splits when it is skewed.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.where("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct())
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = now.agg(F.count("*"), mark).first()
    while before[0]:
        now = written(small_star(large_star(now)).distinct())
        after = now.agg(F.count("*"), mark).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
