"""Versioned entities: batches of stores, archivings, relations and consolidations over copy-on-write tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import SCOPES, TABLES

ARCHIVED = {"status": "archived", "embedding_status": "archived"}


def weight_from_scores(relevance: Column, impact: Column, novelty: Column, actionability: Column, default: Column) -> Column:
    """The mean of the scores, whole and from 1 to 5, missing ones 3; the default if all are missing."""
    scores = [relevance, impact, novelty, actionability]
    total = sum((F.coalesce(s, F.lit(3)) for s in scores[1:]), F.coalesce(scores[0], F.lit(3)))
    mean = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(total / 4))).cast("int")
    return F.when(F.coalesce(*scores).isNull(), default).otherwise(mean)


def input_error(df: DataFrame) -> Column:
    """Why a request is refused, or null. Columns: owner_id, scope, title, full_content, metadata."""
    path = F.get_json_object("metadata", "$.source_path")
    absolute = path.rlike(r"^(?:[a-zA-Z]:|/|\\)") | path.contains("/Users/") | path.contains("\\Users\\") | path.contains("/home/")
    blank = lambda c: F.coalesce(X.strip(F.col(c)), F.lit("")) == ""
    return (
        F.when(blank("owner_id"), "owner_id is missing").when(blank("full_content"), "content is blank").when(~F.col("scope").isin(*SCOPES), "scope is unknown").when(blank("title"), "title is blank")
        .when(F.col("title").rlike(r"(?i)^[a-z0-9_.-]+\.(?:md|txt|json|ya?ml)\s*[-—–:|]\s*"), "title begins with a file name").when(absolute, "source_path is absolute")
    )


def history(feed: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Slowly-changing history of a change feed: version, valid_from, valid_to (the next version's start) and is_current."""
    w = Window.partitionBy(key).orderBy(*order)
    out = feed.withColumn("version", F.row_number().over(w)).withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))
    return out.withColumn("is_current", F.col("valid_to").isNull())


def upsert(state: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """One batch of stores over the entities, a request for each id at most.

    The replaced version stays as <id>_h_<8 hex>, archived and closed; the new one keeps created_at and parent_ids,
    takes owner, project and context from the old one where it has none, and is raw again.
    """
    cols = list(TABLES["entities"].fieldNames())
    new = requests.select([F.col(c).alias(f"n_{c}") for c in cols])
    joined = state.join(new, F.col("id") == F.col("n_id"), "full")
    hit = F.col("n_id").isNotNull()
    old = F.col("id").isNotNull()
    kept = {"created_at": F.coalesce("created_at", now), "parent_ids": F.coalesce("parent_ids", "n_parent_ids"), "valid_to": F.lit(None).cast("timestamp"), "updated_at": now, "last_accessed_at": now, "status": F.lit("raw")}
    kept |= {c: F.coalesce(f"n_{c}", c) for c in ("owner_id", "project_id", "context_id")}
    kept |= {"embedding_status": F.when(old, F.col("embedding_status")).otherwise("pending"), "valid_from": now}
    current = joined.select([F.when(hit, kept.get(c, F.col(f"n_{c}"))).otherwise(F.col(c)).alias(c) for c in cols])
    suffix = F.substring(F.sha2(F.concat_ws("|", "id", F.col("updated_at").cast("string")), 256), 1, 8)
    closed = {"id": F.concat("id", F.lit("_h_"), suffix), "valid_from": F.coalesce("valid_from", "created_at"), "valid_to": now} | {k: F.lit(v) for k, v in ARCHIVED.items()}
    past = joined.where(hit & old).select([closed.get(c, F.col(c)).alias(c) for c in cols])
    return current.unionByName(past)


def archive(state: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, (id, result)) after archiving; requests: id, owner_id (null: anybody). The result of each request says why it failed, if it did."""
    asked = requests.select("id", F.col("owner_id").alias("by"))
    found = asked.join(state.select("id", F.col("owner_id").alias("owner"), "status"), "id", "left")
    result = found.select("id", F.when(F.col("status").isNull(), "not found").when(F.col("status") == "archived", "already archived").when(F.col("by").isNotNull() & ~F.col("by").eqNullSafe(F.col("owner")), "not the owner").otherwise("archived").alias("result"))
    done = result.where("result = 'archived'").select(F.col("id").alias("done")).distinct()
    hit = F.col("done").isNotNull()
    change = {k: F.lit(v) for k, v in ARCHIVED.items()} | {"updated_at": now, "valid_to": now}
    after = state.join(done, F.col("id") == F.col("done"), "left").select([F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in state.columns])
    return after, result


def add_relations(relations: DataFrame, entities: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(relations, (seq, result)); requests: seq, source_id, target_id, predicate. Ends must exist and differ."""
    ids = entities.select("id")
    checked = requests.join(ids.select(F.col("id").alias("s")), F.col("source_id") == F.col("s"), "left").join(ids.select(F.col("id").alias("t")), F.col("target_id") == F.col("t"), "left")
    result = F.when(F.col("source_id") == F.col("target_id"), "self-loop").when(F.col("s").isNull(), "no source").when(F.col("t").isNull(), "no target").when(F.coalesce("predicate", F.lit("")) == "", "no predicate").otherwise("stored")
    checked = checked.withColumn("result", result)
    good = checked.where("result = 'stored'").select(F.sha2(F.concat_ws("|", F.lit("edge"), "seq", "source_id", "target_id", "predicate", now.cast("string")), 256).alias("id"), "source_id", "target_id", "predicate", now.alias("created_at"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return relations.unionByName(good), checked.select("seq", "result")


def repoint(relations: DataFrame, moved: DataFrame, keep: tuple[str, ...] = ("consolidated_from",)) -> DataFrame:
    """Edges with ends moved from parent to id (moved: parent, id); loops that arise are dropped, edges of the predicates in keep stay."""
    s, t = moved.select(F.col("parent").alias("sp"), F.col("id").alias("si")), moved.select(F.col("parent").alias("tp"), F.col("id").alias("ti"))
    stay = F.col("predicate").isin(*keep)
    joined = relations.join(s, (F.col("source_id") == F.col("sp")) & ~stay, "left").join(t, (F.col("target_id") == F.col("tp")) & ~stay, "left")
    change = {"source_id": F.coalesce("si", "source_id"), "target_id": F.coalesce("ti", "target_id")}
    out = joined.select([change[c].alias(c) if c in change else F.col(c) for c in relations.columns], )
    return out.where(F.col("source_id") != F.col("target_id"))


def consolidate(entities: DataFrame, relations: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) after consolidations; requests: id, parent_ids, title, full_content, owner_id (null: system), scope, weight,
    and what else of context_id and the quality columns there is.

    The new rows are consolidated, their parents archived, edges of the parents moved to them and lineage edges added.
    A parent in several requests moves to the least id.
    """
    moved = requests.select("id", F.explode("parent_ids").alias("parent")).join(entities.select(F.col("id").alias("parent")), "parent", "left_semi")
    cols, more = TABLES["entities"].fields, {c: F.col(c) for c in ("context_id", "quality_score", "quality_status", "quality_flags") if c in requests.columns}
    made = requests.select(*[{
        "id": F.col("id"), "parent_ids": F.col("parent_ids"), "title": F.col("title"), "full_content": F.col("full_content"), "owner_id": F.coalesce("owner_id", F.lit("system")), "scope": F.col("scope"), "weight": F.col("weight"),
        "status": F.lit("consolidated"), "embedding_status": F.lit("pending"), "is_core": F.lit(False), "content_hash": X.content_hash(F.col("full_content")), **more,
    }.get(f.name, now if f.name in ("created_at", "updated_at", "last_accessed_at", "valid_from") else F.lit(None)).cast(f.dataType).alias(f.name) for f in cols])
    after, _ = archive(entities, moved.select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("owner_id")).distinct(), now)
    edges = repoint(relations, moved.groupBy("parent").agg(F.min("id").alias("id")))
    lineage = moved.select(F.sha2(F.concat_ws("|", F.lit("lineage"), "id", "parent"), 256).alias("id"), F.col("id").alias("source_id"), F.col("parent").alias("target_id"), F.lit("consolidated_from").alias("predicate"), now.alias("created_at"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return after.unionByName(made), edges.unionByName(lineage)
