"""Connected components of an edge list by alternating large-star and small-star rounds, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, Written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (a, b). Large star: each node ties its larger neighbours to the least of its neighbourhood; small star: its smaller ones and itself."""
    if small:
        ties = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        ties = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ties.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = ties.join(least, ties["u"] == least["w"])
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(edges: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(a, b), longs, to (node, root): the root is the least node of the component; nodes without an edge are absent.

    The result reads a table that goes with the scope. A node of very many edges is one key of a join whose other side has one row for it, which
    adaptive execution splits.
    """
    now = Written(edges.select("a", "b").where("a != b").distinct(), "edges")
    mark = None
    while True:
        large = Written(_star(now.df, small=False), "large-star")
        now.drop()
        now = Written(_star(large.df, small=True), "small-star")
        large.drop()
        found = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(found) == mark:
            if scope:
                scope.tables.append(now)
            # every edge now ties a node to its root
            nodes = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
        mark = tuple(found)
