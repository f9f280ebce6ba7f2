"""Counts and pages for a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hybrid import active, ranked

PAGE, RELATIONS_PAGE = 50, 200


def status_counts(df: DataFrame, col: str = "status") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def stats(entities: DataFrame, events: DataFrame, relations: DataFrame, tags: DataFrame) -> DataFrame:
    """One row of totals; each table is read once, and the rows joined are single."""
    live = F.col("status") != "archived"
    one = entities.agg(
        F.count_if(F.col("status") == "raw").alias("raw"), F.count_if(F.col("status") == "consolidated").alias("consolidated"), F.count_if(~live).alias("archived"),
        F.count_if(live & (F.col("scope") == "private")).alias("private"), F.count_if(live & (F.col("scope") == "shared")).alias("shared"),
        F.count_if(live & (F.col("embedding_status") == "ready")).alias("ready"), F.count_if(live & (F.coalesce("embedding_status", F.lit("pending")).isin("pending", ""))).alias("pending"), F.count_if(live & (F.col("embedding_status") == "failed")).alias("failed"),
    )
    for name, df in (("events", events), ("relations", relations), ("tags", tags)):
        one = one.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))
    return one


def embedding_stats(entities: DataFrame) -> DataFrame:
    live, s = F.col("status") != "archived", F.coalesce("embedding_status", F.lit(""))
    out = entities.agg(*[F.count_if(s == x).alias(x) for x in ("pending", "ready", "failed", "archived")], F.count_if(live & (s == "")).alias("unset"), F.count_if(live).alias("active"))
    return out.withColumn("ready_percent", F.round(F.col("ready") / F.greatest(F.lit(1), F.col("active")) * 100).cast("long"))


def page_of(value: object) -> int:
    """A page number from a request: whole and at least 1, else 1."""
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return 1


def page(df: DataFrame, order: list[Column], number: object = 1, size: int = PAGE) -> DataFrame:
    return df.orderBy(*order).offset((page_of(number) - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = PAGE) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).alias("total_pages"))


def entity_filter(owner: str | None = None, status: str | None = None, context: str | None = None, is_core: str | None = None) -> Column:
    """The list's filters; is_core is true for true, 1 and yes."""
    out = F.lit(True)
    if owner is not None:
        out = out & (F.col("owner_id") == owner)
    if status is not None:
        out = out & (F.col("status") == status)
    if context is not None:
        out = out & F.coalesce((F.col("context_id") == context) | (F.col("project_id") == context), F.lit(False))
    if is_core is not None:
        out = out & (F.col("is_core") == (is_core.lower() in ("true", "1", "yes")))
    return out


def display_status() -> Column:
    """What a list shows of a row's embedding: archived rows as such, and rows without a state as pending."""
    return F.when(F.col("status") == "archived", "archived").otherwise(F.coalesce(F.nullif("embedding_status", F.lit("")), F.lit("pending")))


def tagged(entities: DataFrame, entity_tags: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """Entities linked to the tag of exactly this name, which may be an alias."""
    linked = entity_tags.join(tags.where(F.col("name") == name).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return entities.join(linked.select(F.col("entity_id").alias("id")), "id", "left_semi")


LIST_COLUMNS = ["id", "created_at", "updated_at", "last_accessed_at", "owner_id", "scope", "is_core", "weight", "status", "parent_ids", "title", "context_id"]


def entity_list(entities: DataFrame, entity_tags: DataFrame, tags: DataFrame, number: object = 1, tag: str | None = None, size: int = PAGE, **filters: str | None) -> tuple[DataFrame, DataFrame]:
    """(page, totals) of the list: the latest updates first, with display status and tag names. Filters are those of entity_filter, and a tag by its exact name.

    The page is cut before tags are joined, so names are gathered for its rows alone.
    """
    rows = entities.where(entity_filter(**filters))
    rows = rows if tag is None else tagged(rows, entity_tags, tags, tag)
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("timestamp").alias(c) for c in LIST_COLUMNS]
    order = [F.desc("updated_at"), F.col("id")]
    one = page(rows.select(*have, display_status().alias("embedding_status")), order, number, size)
    held = entity_tags.join(F.broadcast(one.select(F.col("id").alias("entity_id"))), "entity_id")  # a page's ids
    names = held.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    full = one.join(names, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).orderBy(*order)
    return full, page_totals(rows, size)


def relation_list(relations: DataFrame, entities: DataFrame, number: object = 1, predicate: str | None = None, size: int = RELATIONS_PAGE) -> tuple[DataFrame, DataFrame]:
    """(page, totals) of relations, the latest first, with the titles of both ends: an end without one shows its id. Titles are joined to the page alone."""
    rows = relations if predicate is None else relations.where(F.col("predicate") == predicate)
    order = [F.desc("created_at"), F.col("id")]
    one = page(rows.select("id", "source_id", "target_id", "predicate", "created_at"), order, number, size)
    ends = one.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    titles = entities.select("id", "title").join(F.broadcast(ends), "id", "left_semi")  # two a relation of the page
    for side in ("source", "target"):
        one = one.join(titles.select(F.col("id").alias(f"{side}_id"), F.col("title").alias("t")), f"{side}_id", "left").withColumn(f"{side}_title", F.coalesce(F.nullif("t", F.lit("")), f"{side}_id")).drop("t")
    return one.orderBy(*order), page_totals(rows, size)


def event_line(content: Column) -> Column:
    """A request as what it asks for, another event by its first 80 characters."""
    target, tag = F.get_json_object(content, "$.target"), F.get_json_object(content, "$.tag_name")
    short = F.when(F.length(content) > 80, F.concat(F.substring(content, 1, 80), F.lit("..."))).otherwise(content)
    return F.when(target.isNotNull(), F.rtrim(F.concat_ws(" ", F.lit("Consolidation request for"), target, tag))).otherwise(short)


def overview(entities: DataFrame, events: DataFrame, hits: DataFrame, latest: int = 5, top: int = 3) -> DataFrame:
    """(section, place, label, detail) of what a reader looks at first: rows by status, core rows by weight, the latest events, and the best of hits (id, score) that live.

    place: the count of a status, the weight of a core row, and the place of an event or a hit in its list.
    """
    part = lambda df, name, place, label, detail: df.select(F.lit(name).alias("section"), F.col(place).cast("long").alias("place"), label.alias("label"), detail.alias("detail"))
    out = part(status_counts(entities), "status", "n", F.upper("status"), F.lit(None).cast("string"))
    out = out.unionByName(part(entities.where(active() & F.col("is_core")), "core", "weight", F.col("title"), F.col("id")))
    newest = [F.desc("timestamp"), F.desc("id")]
    last = ranked(events.select("id", "timestamp"), newest, latest).withColumnRenamed("rank", "place")
    shown = events.select("id", F.concat_ws(" ", F.col("agent_id").cast("string"), F.upper("type")).alias("who"), "content").join(F.broadcast(last), "id")  # latest rows
    out = out.unionByName(part(shown, "event", "place", F.col("who"), event_line(F.col("content"))))
    found = hits.join(entities.where(active()).select("id", "title", "weight"), "id")
    best = ranked(found, [F.desc("score"), F.col("id")], top).withColumnRenamed("rank", "place").join(found, "id")
    return out.unionByName(part(best, "search", "place", F.col("title"), F.concat_ws(" ", F.format_number("score", 4), F.col("weight").cast("string"))))
