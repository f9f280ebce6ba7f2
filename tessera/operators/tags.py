"""Tags: listing, usage, writing and canonicalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def canonical(tags: DataFrame, contains: str | None = None) -> DataFrame:
    """Canonical tags, those whose name holds a text in any case if one is given."""
    out = tags.where(F.col("canonical_id").isNull())
    return (out if contains is None else out.where(F.lower("name").contains(contains.lower()))).select("id", "name").orderBy("name")


def usage(tags: DataFrame, entity_tags: DataFrame) -> DataFrame:
    """Every tag with the number of its links, most first."""
    n = entity_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count("entity_id").alias("n"))
    return tags.join(n, "id", "left").select("id", "name", "canonical_id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name")


def names_by_entity(entity_tags: DataFrame, tags: DataFrame) -> DataFrame:
    return entity_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))


def link(tags: DataFrame, entity_tags: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, entity_tags) after linking wanted (entity_id, name): by exact name, else by key, else a new tag; aliases lead to their canonical tag."""
    ask = wanted.select("entity_id", X.tag_name(F.col("name")).alias("asked")).withColumn("k", X.tag_key(F.col("asked")))
    root = F.coalesce("canonical_id", "id")
    exact = tags.select(F.col("name").alias("asked"), root.alias("by_name"))
    loose = tags.groupBy(X.tag_key(F.col("name")).alias("k")).agg(F.min_by(root, F.struct("created_at", "id")).alias("by_key"))
    found = ask.join(exact, "asked", "left").join(loose, "k", "left").withColumn("tag_id", F.coalesce("by_name", "by_key", F.sha2(F.concat(F.lit("tag|"), "k"), 256)))
    new = found.where("by_name is null and by_key is null").groupBy(F.col("tag_id").alias("id")).agg(F.min("asked").alias("name"))
    made = tags.unionByName(new.select("id", "name", F.lit(None).cast("string").alias("canonical_id"), F.current_timestamp().alias("created_at")))
    return made, entity_tags.unionByName(found.select("entity_id", "tag_id")).dropDuplicates(["entity_id", "tag_id"])


def merge(tags: DataFrame, entity_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, entity_tags) after folding spellings: of the canonical tags of one key the first made stays, the others become its aliases and their links move."""
    w = Window.partitionBy("k").orderBy("created_at", "id")
    first = tags.where("canonical_id is null").withColumn("k", X.tag_merge_key(F.col("name"))).withColumn("root", F.first("id").over(w)).where("root <> id").select(F.col("id").alias("alias"), "root")
    folded = tags.join(first, F.col("id") == F.col("alias"), "left").withColumn("canonical_id", F.coalesce("root", "canonical_id")).drop("alias", "root")
    moved = entity_tags.join(first, F.col("tag_id") == F.col("alias"), "left").select("entity_id", F.coalesce("root", "tag_id").alias("tag_id")).dropDuplicates(["entity_id", "tag_id"])
    return folded, moved
