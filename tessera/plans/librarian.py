"""Batch jobs that look for what is worth consolidating; their requests are events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import tags as T
from tessera.operators.events import REQUEST
from tessera.operators.vector import greedy_clusters, newer_neighbours, pairs_among
from tessera.session import checkpointed

DENSE, DENSE_SOONER, NEAR = 5, 3, 0.25
COOLDOWN_S, STALE_LOCK_S = 300, 600
#: About how many ids a request names; a larger group makes several requests.
PART = 10_000
#: Over how many tasks a group is counted.
SALTS = 16


def _request(df: DataFrame, owner: Column, fields: list[Column], now: Column) -> DataFrame:
    content = F.to_json(F.struct(*fields))
    uid = F.sha2(F.concat_ws("|", content, now.cast("string")), 256)
    return df.select(uid.alias("id"), now.alias("timestamp"), F.coalesce(owner, F.lit("librarian")).alias("agent_id"), F.lit(REQUEST).alias("type"), content.alias("content"), *[F.lit(None).cast("string").alias(c) for c in ("error_code", "session_id", "context_id")])


def in_parts(rows: DataFrame, keys: list[str], least: Column | int, size: int = PART) -> DataFrame:
    """(keys, n, part, entity_ids) of the groups that have at least so many rows: their ids, in parts of about size, and how many there are in all.

    A row's part follows from its id, so that neither a task nor a row of the result holds a large group whole; groups are counted
    by salt first, and each salt finds the sum. Null keys are groups like any other.
    """
    rows = rows.select(*keys, F.col("id").alias("entity_id"), F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long").alias("h")).withColumn("salt", F.col("h") % SALTS)
    n = rows.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where(F.col("n") >= least)
    n = n.select(*[F.col(k).alias(f"{k}_") for k in keys], "n", F.explode("salts").alias("salt_"))
    same = F.col("salt") == F.col("salt_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    part = F.pmod(F.floor(F.col("h") / SALTS), F.ceil(F.col("n") / size)).alias("part")
    return rows.join(n, same).select(*keys, "n", part, "entity_id").groupBy(*keys, "n", "part").agg(F.array_sort(F.collect_list("entity_id")).alias("entity_ids"))


def dense_tags(entities: DataFrame, tags: DataFrame, entity_tags: DataFrame, size: int = PART) -> DataFrame:
    """(tag_name, owner_id, n, part, entity_ids) of tags with many raw entities of one owner; fewer are enough for runbooks and decisions."""
    raw = entities.where("status = 'raw'").select("id", "owner_id")
    linked = entity_tags.join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name")), "tag_id")
    sooner = F.lower("tag_name").contains("runbook") | F.lower("tag_name").contains("decision")
    return in_parts(raw.join(linked.select(F.col("entity_id").alias("id"), "tag_name"), "id"), ["tag_name", "owner_id"], F.when(sooner, DENSE_SOONER).otherwise(DENSE), size)


def accumulated(entities: DataFrame, least: int = DENSE, size: int = PART) -> DataFrame:
    """(owner_id, scope, n, part, entity_ids) of owners and scopes with many raw entities."""
    return in_parts(entities.where("status = 'raw'"), ["owner_id", "scope"], least, size)


def ready_vectors(entities: DataFrame, embeddings: DataFrame, status: str) -> DataFrame:
    return entities.where((F.col("status") == status) & (F.col("embedding_status") == "ready")).join(embeddings.withColumnRenamed("entity_id", "id"), "id")


def vector_clusters(entities: DataFrame, embeddings: DataFrame, distance: float = NEAR) -> DataFrame:
    v = ready_vectors(entities, embeddings, "raw").select("id", "embedding")
    pairs = checkpointed(pairs_among(v, distance).select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return greedy_clusters(both.unionByName(v.select(F.col("id").alias("a"), F.col("id").alias("b"))))


def superseding(entities: DataFrame, embeddings: DataFrame, distance: float = NEAR) -> DataFrame:
    old, new = ready_vectors(entities, embeddings, "consolidated"), ready_vectors(entities, embeddings, "raw")
    return newer_neighbours(old.select("id", "embedding", F.coalesce("valid_from", "created_at").alias("at")), new.select("id", "embedding", F.col("created_at").alias("at")), distance)


def decayed(entities: DataFrame, now: Column, rate: float = 0.05, floor: float = 0.15) -> DataFrame:
    """(id, score) of entities that time has worn down: weight * quality * e^(-rate * days), below the floor. Core and pinned ones don't decay. An opt-in job."""
    seen = F.coalesce("last_accessed_at", "updated_at")
    days = (F.unix_micros(now) - F.unix_micros(seen)) / 86_400_000_000
    pinned = F.coalesce(F.lower(F.get_json_object("metadata", "$.is_pinned")).isin("true", "1", "yes"), F.lit(False))
    score = F.coalesce("weight", F.lit(1)) * F.coalesce("quality_score", F.lit(0.5)) * F.exp(-rate * days)
    return entities.where((F.col("status") != "archived") & ~F.coalesce("is_core", F.lit(False)) & ~pinned).select("id", score.alias("score")).where(F.col("score") < floor)


def due(raw_rows: int, seconds_since_last: float | None) -> bool:
    return raw_rows >= 2 and (seconds_since_last is None or seconds_since_last >= COOLDOWN_S)


def run(entities: DataFrame, tags: DataFrame, entity_tags: DataFrame, embeddings: DataFrame, now: Column, distance: float = NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, entity_tags, requests): spellings are merged first, as the dense tags are counted over merged ones."""
    tags, entity_tags = T.merge(tags, entity_tags)
    c, ids = F.col, F.col("entity_ids")
    out = _request(dense_tags(entities, tags, entity_tags), c("owner_id"), [F.lit("tag").alias("target"), c("tag_name"), ids], now)
    out = out.unionByName(_request(accumulated(entities), c("owner_id"), [F.lit("general").alias("target"), c("owner_id"), c("scope"), ids], now))
    owner = entities.select(c("id").alias("seed"), "owner_id")
    clusters = vector_clusters(entities, embeddings, distance).join(owner, "seed")
    out = out.unionByName(_request(clusters, c("owner_id"), [F.lit("vector_cluster").alias("target"), c("owner_id"), c("members").alias("entity_ids")], now))
    newer = superseding(entities, embeddings, distance).join(entities.select("id", "title", "owner_id"), "id")
    fields = [F.lit("supersession_candidate").alias("target"), c("id").alias("consolidated_entity_id"), c("title").alias("consolidated_title"), c("members").alias("new_raw_entity_ids")]
    return tags, entity_tags, out.unionByName(_request(newer, c("owner_id"), fields, now))
