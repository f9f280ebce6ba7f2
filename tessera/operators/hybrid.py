"""Predicates shared by searches, rank fusion, hybrid search and neighbour expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

RRF_K = 60


def active() -> Column:
    return F.col("status") != "archived"


def visible(owner: str | None) -> Column:
    return F.lit(True) if owner is None else (F.col("owner_id") == owner) | (F.col("scope") == "shared")


def in_context(context: str) -> Column:
    """The context column, the project column or either key of the metadata."""
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    return F.coalesce((F.col("context_id") == context) | (F.col("project_id") == context) | (meta("project") == context) | (meta("project_id") == context), F.lit(False))


def metadata_is(values: dict[str, object], column: str = "metadata") -> Column:
    """Equality as text of every key."""
    out = F.lit(True)
    for k, v in values.items():
        out = out & (F.get_json_object(column, f"$.{k}") == str(v))
    return out


def valid_at(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at))


def decode_cursor(cursor: str | None) -> int:
    """offset:N; anything else is the beginning."""
    head, _, n = (cursor or "").partition(":")
    return int(n) if head == "offset" and n.isdigit() else 0


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the cursor of the next one."""
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("cursor", F.lit(f"offset:{offset + limit}"))


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """(id, rank) of the first rows; the top-k comes before the numbering, so one task numbers limit rows at most."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "rank")


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) lists: (id, rrf), best first; ties as in the lexical list, then in the other."""
    both = lexical.select("id", F.col("rank").alias("l"), F.lit(None).cast("int").alias("s")).unionByName(semantic.select("id", F.lit(None).cast("int").alias("l"), F.col("rank").alias("s")))
    score = F.coalesce(1 / (k + F.max("l")), F.lit(0.0)) + F.coalesce(1 / (k + F.max("s")), F.lit(0.0))
    one = both.groupBy("id").agg(score.alias("rrf"), F.max("l").alias("l"), F.max("s").alias("s"))
    return one.orderBy(F.desc("rrf"), F.asc_nulls_last("l"), F.asc_nulls_last("s"), "id").limit(limit)


def in_degree(relations: DataFrame, at: Column) -> DataFrame:
    """(id, degree) of incoming edges valid at a time."""
    return relations.where(valid_at(at)).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def lexical_order(hits: DataFrame, entities: DataFrame, degrees: DataFrame) -> DataFrame:
    """Hits (id, score) with the order of results: -score * weight - degree / 10 ascending, then the latest update, then the id."""
    full = hits.join(entities, "id").join(degrees, "id", "left")
    return full.withColumn("ordering", -F.col("score") * F.col("weight") - 0.1 * F.coalesce("degree", F.lit(0)))


def neighbours(hits: DataFrame, relations: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """(id, related): up to most neighbours of each hit in either direction, neither hits nor archived, edges first come.

    An OR over both ends would be a nested loop: it is the union of two equi-joins.
    """
    ends = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "predicate", F.col("id").alias("edge"))
    ends = ends.unionByName(relations.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "predicate", F.col("id").alias("edge")))
    ids = hits.select("id")
    near = ends.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "other"), "other", "left_anti")
    near = near.join(entities.where(active()).select(F.col("id").alias("other"), "title"), "other")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("edge", "other"))
    return near.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "other", "predicate"))), lambda x: F.struct(x["other"].alias("id"), x["predicate"].alias("predicate"))).alias("related"))


def with_tags(entity_tags: DataFrame, tags: DataFrame, wanted: list[str], operator: str = "OR") -> DataFrame:
    """Ids of entities with any (OR) or all (AND) of the tags; aliases stand for their canonical tag, unknown tags match nothing."""
    spark = tags.sparkSession
    want = spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "w string").select("w", X.tag_key(F.col("w")).alias("k"))
    root = tags.select(F.col("id").alias("t"), F.coalesce("canonical_id", "id").alias("root"), X.tag_key(F.col("name")).alias("k"))
    roots = root.join(F.broadcast(want), "k").select("w", "root").distinct()
    linked = entity_tags.join(root.select(F.col("t").alias("tag_id"), "root"), "tag_id").join(roots, "root").groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("w").alias("n"))
    return linked.where(F.col("n") >= (len(dict.fromkeys(wanted)) if operator.upper() == "AND" else 1)).select("id")
