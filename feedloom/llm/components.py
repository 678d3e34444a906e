"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a partial minimum per node and one join, so neither a component nor a node's neighbours are ever gathered
in one place; the table of each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialise


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the smallest of u and all its v."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(lowest, pairs.u == lowest["_u"]).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_minimum(both).where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = _with_minimum(down)
    moved = near.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(near.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it can reach. Nulls and loops are ignored.

    Nodes may be of any ordered type. An empty edge table gives an empty result. Rounds grow with the logarithm of the longest path.
    """
    edges = materialise(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct())
    before = _state(edges)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
