"""Connected components of a graph in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stash


def _pulled(pairs: DataFrame, onto: DataFrame) -> DataFrame:
    """pairs (u, v) with the smallest of u and all its v as m."""
    least = onto.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> node, root: for each node in an edge the smallest node reachable.

    Each round writes its edges to the shared folder; they become stars around the smallest nodes in about as
    many rounds as the logarithm of the longest path. Loops, repeated and null ends do no harm; no edges, no rows.
    """
    stars = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(stars)
    while mark[0]:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        large = _pulled(both.where("v > u"), both).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _pulled(large, large).select("v", "u", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        stars = stash(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(stars.select("b", "b")).distinct()
