"""The property graph: bounded traversal, lineage, degrees, topology, orphans, detail, resolution of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.hybrid import active, valid_at
from tessera.session import written


def closure(relations: DataFrame, root: str, at: Column, max_depth: int = 5) -> DataFrame:
    """(source_id, target_id, predicate, depth, path) of every path from the root along edges valid at a time; no path meets a node twice.

    One equi-join a level, max_depth at most, each against the frontier of the level before.
    """
    edges = relations.where(valid_at(at)).select("source_id", "target_id", "predicate")
    front = edges.where(F.col("source_id") == root).where(F.col("target_id") != root).select("source_id", "target_id", "predicate", F.lit(1).alias("depth"), F.array("source_id", "target_id").alias("path"))
    out = front
    for depth in range(2, max_depth + 1):
        ahead = front.select(F.col("target_id").alias("source_id"), "path")
        front = edges.join(ahead, "source_id").where(~F.array_contains("path", F.col("target_id"))).select("source_id", "target_id", "predicate", F.lit(depth).alias("depth"), F.concat("path", F.array("target_id")).alias("path"))
        out = out.unionByName(front)
    return out


def depths(relations: DataFrame, root: str, at: Column, max_depth: int = 5) -> DataFrame:
    """(id, depth, parent, predicate) of the nodes that can be reached from the root along edges valid at a time: the least depth, and the edge by which it is
    reached there (of several, from the least parent, then by the least predicate).

    Semi-naive: each level joins the edges with the nodes that the level before was the first to reach, and leaves out those reached already, so a
    level's work is the edges of its own nodes, whatever the number of paths. The levels are written as they are found.
    """
    edges = relations.where(valid_at(at)).select("source_id", "target_id", "predicate")
    start = relations.sparkSession.createDataFrame([(root, 0, None, None)], "id string, depth int, parent string, predicate string")
    seen, front = start, start
    for depth in range(1, max_depth + 1):
        step = edges.join(front.select(F.col("id").alias("source_id")), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min(F.struct("source_id", "predicate")).alias("by"))
        front = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("by.source_id").alias("parent"), F.col("by.predicate").alias("predicate"))
        front = written(front, "depths")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def paths_to(found: DataFrame, entities: DataFrame, root: str) -> DataFrame:
    """(id, title, depth, path) of nodes by depths(): the titles on the way from the root, which follow the parents level by level."""
    named = lambda df, key: df.join(entities.select(F.col("id").alias("_e"), F.coalesce("title", "id").alias("title")), F.col(key) == F.col("_e")).drop("_e")
    titles = entities.where(F.col("id") == root).agg(F.coalesce(F.max("title"), F.lit(root)).alias("title"))
    level = titles.select(F.lit(root).alias("id"), F.col("title").alias("path"))
    found, out = written(named(found, "id"), "named"), None
    for depth in range(1, (found.agg(F.max("depth")).first()[0] or 0) + 1):
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("before"))
        rows = found.where(F.col("depth") == depth).join(above, "parent", "left").select("id", "title", "depth", F.concat_ws(" -> ", "before", "title").alias("path"))
        level = rows.select("id", "path")
        out = rows if out is None else out.unionByName(rows)
    return found.select("id", "title", "depth", F.lit("").alias("path")).limit(0) if out is None else out


def path_titles(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """Paths as titles joined by arrows."""
    each = paths.select("path", F.posexplode("path").alias("pos", "id")).join(entities.select("id", F.coalesce("title", "id").alias("title")), "id", "left")
    named = each.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("title", "id").alias("title")))).alias("t"))
    return named.select("path", F.array_join(F.col("t.title"), " -> ").alias("titles"))


def lineage_by_parents(entities: DataFrame, root: str, max_depth: int = 10) -> DataFrame:
    """(id, depth) of the ancestors by parent_ids, the root at 0, each way there once."""
    parents = entities.select("id", F.explode("parent_ids").alias("parent"))
    front = entities.where(F.col("id") == root).select("id", F.lit(0).alias("depth"))
    out = front
    for depth in range(1, max_depth + 1):
        front = parents.join(front.select("id"), "id").select(F.col("parent").alias("id")).join(entities.select("id"), "id", "left_semi").withColumn("depth", F.lit(depth))
        out = out.unionByName(front)
    return out


def lineage_by_edges(relations: DataFrame, root: str, predicate: str = "consolidated_from", max_depth: int = 10) -> DataFrame:
    """(id, depth), distinct, along edges of one predicate. Each level is written as it is found, and the walk ends with the first empty one."""
    edges = relations.where(F.col("predicate") == predicate).select("source_id", "target_id")
    front = relations.sparkSession.createDataFrame([(root, 0)], "id string, depth int")
    out = front
    for depth in range(1, max_depth + 1):
        front = written(edges.join(front.select(F.col("id").alias("source_id")), "source_id").select(F.col("target_id").alias("id")).distinct().withColumn("depth", F.lit(depth)), "lineage")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def edges_touching(relations: DataFrame, ids: DataFrame, predicate: str | None = None) -> DataFrame:
    """The edges, each once, an end of which is among ids (id). The OR over both ends is a union of semi-joins, the second without what the first has."""
    rel = relations if predicate is None else relations.where(F.col("predicate") == predicate)
    ids = ids.select("id").distinct()
    source, target = ids.withColumnRenamed("id", "source_id"), ids.withColumnRenamed("id", "target_id")
    return rel.join(source, "source_id", "left_semi").unionByName(rel.join(source, "source_id", "left_anti").join(target, "target_id", "left_semi"))


def lineage_graph(entities: DataFrame, relations: DataFrame, root: str, predicate: str = "consolidated_from", max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the lineage by edges: (id, depth, title, status, owner_id, updated_at) of what is stored, and all edges of the predicate that touch the
    set, whether their other end is in it or not."""
    found = written(lineage_by_edges(relations, root, predicate, max_depth), "lineage")
    nodes = found.join(entities.select("id", "title", "status", "owner_id", "updated_at"), "id").select("id", "depth", "title", "status", "owner_id", "updated_at")
    return nodes, edges_touching(relations, found, predicate).select("source_id", "target_id", "predicate")


def one_hop(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, near): for each of ids (id) itself and the other ends of its edges, each once; ids without edges have themselves alone."""
    ids = ids.select("id").distinct()
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("near")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("near")))
    return out.join(ids, "id", "left_semi").unionByName(ids.select("id", F.col("id").alias("near"))).distinct()


def topology(relations: DataFrame, entities: DataFrame, predicate: str | None = None, exclude_archived: bool = True, limit: int | None = 250) -> DataFrame:
    """Edges with titles and status of both ends, the newest first; ends that are missing count as raw."""
    side = lambda p: entities.select(F.col("id").alias(f"{p}_id"), F.coalesce("title", "id").alias(f"{p}_title"), F.col("status").alias(f"{p}_status"))
    full = relations.join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    full = full.withColumns({f"{p}_title": F.coalesce(f"{p}_title", F.lit("Unknown")) for p in ("source", "target")} | {f"{p}_status": F.coalesce(f"{p}_status", F.lit("raw")) for p in ("source", "target")})
    if exclude_archived:
        full = full.where("source_status <> 'archived' and target_status <> 'archived'")
    if predicate is not None:
        full = full.where(F.col("predicate") == predicate)
    full = full.orderBy(F.desc("created_at"), "id")
    return full if limit is None else full.limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges by node; a loop counts twice."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def with_least_degree(edges: DataFrame, least: int) -> DataFrame:
    """Edges both of whose ends have the degree."""
    keep = degrees(edges).where(F.col("degree") >= least).select("id")
    return edges.join(keep.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(keep.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def levels(nodes: DataFrame) -> DataFrame:
    """(depth, ids) of a tree's levels."""
    return nodes.groupBy("depth").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def orphans(entities: DataFrame, relations: DataFrame, owner: str | None = None) -> DataFrame:
    """Raw entities without any edge. The OR over both ends is a union, anti-joined."""
    ends = relations.select(F.col("source_id").alias("id")).unionByName(relations.select(F.col("target_id").alias("id"))).distinct()
    raw = entities.where(F.col("status") == "raw")
    return (raw if owner is None else raw.where(F.col("owner_id") == owner)).join(ends, "id", "left_anti")


def detail(entities: DataFrame, relations: DataFrame, entity_tags: DataFrame, tags: DataFrame, wanted: str) -> DataFrame:
    """One entity with its tags and its outgoing and incoming edges."""
    one = entities.where(F.col("id") == wanted)
    names = entity_tags.where(F.col("entity_id") == wanted).join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").agg(F.array_sort(F.collect_list("name")).alias("tags"))
    edge = lambda me, other: relations.where(F.col(me) == wanted).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), "predicate"))).alias("outgoing" if me == "source_id" else "incoming"))
    return one.join(F.broadcast(names)).join(F.broadcast(edge("source_id", "target_id"))).join(F.broadcast(edge("target_id", "source_id")))  # single rows


def resolve_ids(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(input, id): an id as it is, else the whole or the first UUID inside, else the latest active row of that title, else the input."""
    titled = entities.where(active()).groupBy("title").agg(F.max_by("id", F.struct("updated_at", "id")).alias("by_title"))
    known = asked.join(entities.select(F.col("id").alias("known")), F.col("input") == F.col("known"), "left").join(titled, F.col("input") == F.col("title"), "left")
    return known.select("input", F.coalesce("known", X.uuid_in(F.col("input")), "by_title", "input").alias("id"))


def fuzzy(entities: DataFrame, text: str) -> DataFrame:
    """The row whose id or title is, begins with or holds the text, by status and then id."""
    hit = (F.col("id") == text) | F.col("id").startswith(text) | (F.col("title") == text) | F.lower("title").contains(text.lower())
    return entities.where(hit).orderBy("status", "id").limit(1)
