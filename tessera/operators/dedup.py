"""Exact and near duplicates, and the routing of new texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.similar_sets import similar_pairs

NEAR, SUPERSEDE = 0.25, 0.88


def exact_duplicates(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows (owner_id, content_hash) that an old row equals."""
    return new.join(old.select("owner_id", "content_hash"), ["owner_id", "content_hash"], "left_semi")


def token_pairs(left: DataFrame, right: DataFrame, least: float = NEAR, same: Column | None = None) -> DataFrame:
    """(a, b, similarity) of pairs with Jaccard similarity of at least least, those for which same holds. Both: id, tokens (a sorted set)."""
    found = similar_pairs(left, right, least)
    return found if same is None else found.where(same)


def route(pairs: DataFrame, warn: float = NEAR, supersede: float = SUPERSEDE) -> DataFrame:
    """(a, b, similarity, action): the most similar partner of each a, and whether a supersedes it, is a warning or is stored."""
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    top = pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return top.withColumn("action", F.when(F.col("similarity") >= supersede, "supersede").when(F.col("similarity") >= warn, "warn").otherwise("store"))
