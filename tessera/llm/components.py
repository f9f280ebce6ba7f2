"""Connected components of an edge table by alternating large-star and small-star steps.

All state is a distributed edge table, written to the shared folder each round; the driver only learns whether
some edge doesn't lead to a root yet. After about log(n) rounds every node points at the least node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the least node among itself and its partners v."""
    return pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("at"), F.least("u", "least").alias("least"))


def _round(edges: DataFrame) -> DataFrame:
    """edges (u > v), distinct -> edges (u > v), distinct, of the same components."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Large star: larger partners of u move to the least of u and its partners.
    large = both.join(_least(both), F.col("u") == F.col("at")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u > v").distinct()
    large = materialize(large, "large-star")  # read twice, so the plan of the small star stays small
    # Small star: u and its smaller partners move to the least of them.
    small = large.join(_least(large), F.col("u") == F.col("at"))
    moved = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
    return moved.where("u > v").distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has more than one smaller partner, or both a smaller and a larger one: else all edges lead to roots."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("at"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("at"), F.lit(0).alias("down"), F.lit(1).alias("up")))))
    each = ends.groupBy("at").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not each.where("down > 1 or down > 0 and up > 0").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) of every node that has a link to another; null ends are no nodes."""
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct(), "edges")
    while _unsettled(edges):
        edges = materialize(_round(edges), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
