"""A batch of consolidations with the checks of a store: parents resolved, secrets redacted, quality gate, equal and similar texts, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import quality
from tessera.functions import text as X
from tessera.functions.lexicon import BIGRAMS
from tessera.functions.redact import redact
from tessera.operators import dedup, graph, scd
from tessera.session import checkpointed


def consolidate(entities: DataFrame, relations: DataFrame, requests: DataFrame, now: Column, rules: list[str] | None = None, lexicon: list[str] | None = BIGRAMS, warn: float = dedup.NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, (seq, result, id, similar_to)) after consolidations.

    requests: seq, parent_ids (ids, UUIDs in a text, or titles), title, full_content, owner_id (null: system), scope,
    weight, context_id. Parents that aren't found are left out; without any the request is refused, as are texts that
    the gate rejects and texts equal to a live one of the owner that is no parent. Of equal texts of one owner in a
    batch the first counts. similar_to: the most similar live text that is no parent, a warning only.
    """
    blank = lambda c: F.coalesce(X.strip(F.col(c)), F.lit("")) == ""
    df = requests.withColumns({
        "title": redact(F.col("title"), rules), "full_content": redact(F.col("full_content"), rules), "owner_id": F.coalesce("owner_id", F.lit("system")), "scope": F.coalesce("scope", F.lit("shared")), "weight": F.coalesce("weight", F.lit(1)),
    })
    named = df.select("seq", F.explode("parent_ids").alias("input"))
    known = graph.resolve_ids(named.select("input").distinct(), entities).join(entities.select("id"), "id", "left_semi")
    parents = named.join(known, "input").groupBy("seq").agg(F.array_sort(F.collect_set("id")).alias("parent_ids"))
    df = df.drop("parent_ids").join(parents, "seq", "left")
    df = quality.gate(df, "full_content", lexicon).withColumn("content_hash", X.content_hash(F.col("full_content")))
    live = entities.where("status <> 'archived'")
    same = live.select(F.col("id").alias("twin"), F.col("owner_id").alias("o"), F.col("content_hash").alias("h"))
    twins = df.join(same, (F.col("owner_id") == F.col("o")) & (F.col("content_hash") == F.col("h"))).where(~F.coalesce(F.array_contains("parent_ids", F.col("twin")), F.lit(False)))
    df = df.join(twins.groupBy("seq").agg(F.min("twin").alias("twin")), "seq", "left")
    error = (
        F.when(blank("title") | blank("full_content"), "title or content is missing").when(F.col("parent_ids").isNull(), "no parent found").when(F.col("quality_status") == "REJECT", F.concat(F.lit("quality: "), F.element_at("quality_flags", -1)))
        .when(F.col("twin").isNotNull(), F.concat(F.lit("exact duplicate of "), "twin"))
    )
    df = df.withColumn("error", error)
    nth = F.row_number().over(Window.partitionBy("owner_id", "content_hash").orderBy(F.col("error").isNotNull(), "seq"))
    df = df.withColumn("nth", nth).withColumn("error", F.coalesce("error", F.when(F.col("nth") > 1, "exact duplicate in the batch"))).drop("nth", "twin")
    df = checkpointed(df.withColumn("id", F.sha2(F.concat_ws("|", F.lit("consolidation"), "seq", "title", "content_hash", F.array_join("parent_ids", ",")), 256)))
    good = df.where("error is null")
    tokens = lambda d: d.select("id", X.content_tokens(F.concat_ws(" ", "title", "full_content")).alias("tokens"))
    near = dedup.token_pairs(tokens(good), tokens(live), warn).join(good.select(F.col("id").alias("a"), "parent_ids"), "a").where(~F.array_contains("parent_ids", F.col("b")))
    near = near.groupBy("a").agg(F.max_by("b", F.struct("similarity", "b")).alias("similar_to"))
    after, edges = scd.consolidate(entities, relations, good, now)
    out = df.join(near, F.col("id") == F.col("a"), "left").select("seq", F.coalesce("error", F.lit("stored")).alias("result"), F.when(F.col("error").isNull(), F.col("id")).alias("id"), "similar_to")
    return after, edges, out
