"""The tools of the store by name, over its tables and indexes in a folder. Lists are small pages; batches go through the operators.

Each change is one commit of changed rows together with what the indexes make of them. Searches read the stored index, not the texts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.embed import backfill, hashing_embedder
from tessera.functions.redact import checked_rules
from tessera.operators import dedup, events, graph, hybrid, lexical, report, scd, vector
from tessera.operators import tags as tagging
from tessera.plans import consolidation, librarian
from tessera.plans import store as storing
from tessera.plans.locks import Ephemeral, JobLock, listing
from tessera.session import checkpointed
from tessera.sources import snapshot
from tessera.sources.index import CONTENT, STEMMED, TextIndex

#: Other names under which parameters may come.
SYNONYMS = {
    "query": "query_keywords", "q": "query_keywords", "keywords": "query_keywords", "text": "content", "message": "content", "description": "content", "tag": "tags", "owner": "owner_id", "agent": "agent_id",
    "id": "entity_id", "memory_id": "entity_id", "event_type": "type", "source": "source_id", "target": "target_id", "root": "root_entity_id",
}
#: Where the proper name isn't one of the tool's, the next one that is.
SECOND = {"tag": "tags_filter", "tags": "tags_filter"}


def as_list(tags: str | list[str] | None) -> list[str] | None:
    """Tags given as one text are parted at commas."""
    return [t for t in (x.strip() for x in tags.split(",")) if t] if isinstance(tags, str) else tags


def parameters(given: dict, allowed: set[str]) -> dict:
    """Parameters under their own names; a synonym counts only where the proper name isn't given."""
    proper = lambda k: next((n for n in (k, SYNONYMS.get(k), SECOND.get(k)) if n in allowed), None)
    out = {k: v for k, v in given.items() if k in allowed}
    for k, v in given.items():
        if k not in allowed and proper(k):
            out.setdefault(proper(k), v)
    if unknown := [k for k in given if not proper(k)]:
        raise TypeError(f"unknown parameters: {', '.join(unknown)}")
    return out


#: Names the folder of a store that is given none; and what turns the semantic side of searches off.
ROOT_VARIABLE, SEMANTIC_VARIABLE = "TESSERA_ROOT", "TESSERA_SEMANTIC"


def semantic_enabled() -> bool:
    """False where the environment says 0, false, no or off, in any case."""
    return os.environ.get(SEMANTIC_VARIABLE, "1").strip().lower() not in ("0", "false", "no", "off")

#: How many hits find() gives.
FOUND = 20


def indexed_fields() -> dict:
    return {"title": F.col("title"), "content": F.col("full_content"), "aliases": F.get_json_object("metadata", "$.search_aliases")}


def content_field() -> dict:
    return {"content": F.concat_ws(" ", "title", "full_content")}


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None, redaction_rules: list[str] | None = None, embedder=hashing_embedder):
        root = root or os.environ.get(ROOT_VARIABLE) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera"
        self.spark, self.root, self.embedder = spark, root, embedder
        self.rules, self.refused_rules = checked_rules(spark, redaction_rules or [])
        self.ephemeral, self.lock = Ephemeral(), JobLock(spark, f"{root}/locks")
        self.now = F.current_timestamp
        held = lambda name: lambda: snapshot.state(spark, root)[1].get("indexes", {}).get(name, {})
        self.texts, self.contents = TextIndex(spark, f"{root}/text", STEMMED, held("text")), TextIndex(spark, f"{root}/content", CONTENT, held("content"))

    def call(self, tool: str, **given):
        """A tool by name, with synonyms of its parameters."""
        method = getattr(self, tool)
        code = method.__code__
        return method(**parameters(given, set(code.co_varnames[1 : code.co_argcount])))

    def table(self, name: str) -> DataFrame:
        return snapshot.read(self.spark, self.root, name)

    def _save(self, since: int | None = None, extra: dict | None = None, **tables: DataFrame) -> None:
        """Commits what differs in the tables, with the indexes of what differs in the entities. since: the commit that they were made from; extra: what else the commit keeps."""
        added = {n: df for n, df in tables.items() if n in snapshot.APPENDED}
        changed, gone = {}, {}
        for name in tables.keys() - added.keys():
            rows, keys = snapshot.changes(self.table(name), tables[name], name)
            if not (rows := checkpointed(rows)).isEmpty():
                changed[name] = rows
            # Of the others rows change but never go.
            if name in ("relations", "entity_tags") and not (keys := checkpointed(keys)).isEmpty():
                gone[name] = keys
        if "entities" in changed:
            live, dead = changed["entities"].where(hybrid.active()), changed["entities"].where(~hybrid.active()).select("id")
            extra = (extra or {}) | {"indexes": {"text": self.texts.prepared(live, indexed_fields(), dead), "content": self.contents.prepared(live, content_field(), dead)}}
        if changed or gone or added or extra:
            snapshot.commit(self.spark, self.root, changed=changed, gone=gone, added=added, since=since, extra=extra)

    def reindex(self) -> None:
        """Makes the indexes anew of all live rows, as for a store whose tables were written without them."""
        since, state = snapshot.state(self.spark, self.root)
        if not state.get("indexes", {}).get("text", {}).get("segments"):
            live = self.table("entities").where(hybrid.active())
            snapshot.commit(self.spark, self.root, since=since, extra={"indexes": {"text": self.texts.prepared(live, indexed_fields()), "content": self.contents.prepared(live, content_field())}})

    def _one(self, values: dict, schema: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], schema)

    # Events
    def log_event(self, content="", agent_id="system", type="event", error_code=None, session_id=None, context_id=None):
        row = self._one({"a": agent_id, "t": type, "c": content, "e": error_code, "s": session_id, "x": context_id}, "agent_id string, type string, content string, error_code string, session_id string, context_id string")
        self._save(events=checkpointed(events.event(row, self.now(), self.rules)))

    def get_recent_events(self, agent_id=None, type=None, limit=20, context_id=None) -> DataFrame:
        """The latest events, requests with their status."""
        rows = self.table("events") if context_id is None else self.table("events").where(F.col("context_id") == context_id)
        found = events.with_request_status(events.recent(rows, agent_id, type, limit), self.table("entities"))
        return found.orderBy(F.desc("timestamp"), F.desc("id"))

    def get_session_summary(self, session_id) -> DataFrame:
        return events.session(self.table("events"), session_id)

    # Entities
    def store_memories(self, requests: DataFrame, tags: DataFrame | None = None) -> DataFrame:
        """A batch; tags: (seq, name)."""
        since = snapshot.state(self.spark, self.root)[0]
        ent, rel, result = storing.store(self.table("entities"), self.table("relations"), requests, self.now(), self.rules, similar=self.contents.overlaps)
        result = checkpointed(result)
        out = {"entities": ent, "relations": rel}
        if tags is not None:
            ok = result.where(F.col("result").isin("stored", "updated", "supersedes")).join(tags, "seq").select(F.col("id").alias("entity_id"), "name")
            out["tags"], out["entity_tags"] = tagging.link(self.table("tags"), self.table("entity_tags"), ok)
        self._save(since, **out)
        return result

    def store_memory(self, content=None, title=None, tags=None, owner_id=None, scope="shared", weight=1, is_core=False, entity_id=None, metadata=None, project_id=None, context_id=None, relevance=None, impact=None, novelty=None, actionability=None, skip_duplicate_check=False):
        values = {"seq": 1, "id": entity_id, "owner_id": owner_id, "scope": scope, "title": title, "full_content": content, "weight": weight, "is_core": is_core, "metadata": metadata, "project_id": project_id, "context_id": context_id}
        values |= {"relevance": relevance, "impact": impact, "novelty": novelty, "actionability": actionability, "skip_duplicate_check": skip_duplicate_check}
        row = self._one(values, ", ".join(f"{c} {t or 'long'}" for c, t in storing.REQUEST.items()))
        names = self.spark.createDataFrame([(1, t) for t in as_list(tags)], "seq long, name string") if as_list(tags) else None
        r = self.store_memories(row, names).first()
        return {"result": r["result"], "id": r["id"]}

    def fetch_memory_chunk(self, entity_id):
        row = self._resolved(entity_id).select("id", "full_content").first()
        if row is None:
            return None
        self._save(touches=self._one({"id": row["id"]}, "id string").withColumn("last_accessed_at", self.now()))
        return row["full_content"]

    def _resolved(self, entity_id) -> DataFrame:
        ent = self.table("entities")
        found = graph.resolve_ids(self.spark.createDataFrame([(entity_id,)], "input string"), ent).select(F.col("id").alias("found"))
        return ent.join(F.broadcast(found), F.col("id") == F.col("found")).drop("found")  # one row

    def scan_memories(self, owner_id=None, status_filter=None, limit=20, offset=0, cursor=None) -> DataFrame:
        rows = self.table("entities").where(hybrid.visible(owner_id))
        if status_filter is not None:
            rows = rows.where(hybrid.active() if status_filter == "active" else F.col("status") == status_filter)
        return hybrid.page(rows, [F.desc("updated_at"), F.col("id")], limit, hybrid.decode_cursor(cursor) if cursor else offset)

    def search_memory(self, query_keywords=None, owner_id=None, tags_filter=None, metadata_filter=None, limit=5, context_id=None, is_core=None, tag_operator="AND", cursor=None, semantic=None, explain_mode=False, project_id=None, include_related=True) -> DataFrame:
        """The page of hits with title, snippet and score, and with up to five related entities each unless they aren't asked for. Rank fusion covers all hits, paging comes after it. semantic: by default as semantic_enabled() says."""
        tags_filter, semantic = as_list(tags_filter), semantic_enabled() if semantic is None else semantic
        ent = self.table("entities").where(hybrid.active() & hybrid.visible(owner_id))
        if context_id is not None:
            ent = ent.where(hybrid.in_context(context_id))
        if project_id is not None:
            ent = ent.where(hybrid.in_context(project_id))
        if is_core is not None:
            ent = ent.where(F.col("is_core") == is_core)
        if metadata_filter:
            ent = ent.where(hybrid.metadata_is(metadata_filter))
        if tags_filter:
            ent = ent.join(hybrid.with_tags(self.table("entity_tags"), self.table("tags"), tags_filter, tag_operator), "id", "left_semi")
        at, terms = hybrid.decode_cursor(cursor), self.texts.terms_of(query_keywords)
        if explain_mode:
            return self._explained(query_keywords, tags_filter)
        if not lexical.query_terms(query_keywords):
            out = ent.withColumn("score", F.lit(0.0))
            order = [F.desc("is_core"), F.desc("updated_at"), F.col("id")]
        else:
            hits, n_terms = self.texts.search(query_keywords)
            hits = lexical.match_and_or(hits.join(ent.select("id"), "id", "left_semi"), n_terms)
            ranks = hybrid.lexical_order(hits, ent, hybrid.in_degree(self.table("relations"), self.now()))
            lex = hybrid.ranked(ranks, [F.col("ordering"), F.desc("updated_at"), F.col("id")], at + limit)
            sem = lex.limit(0)
            if semantic:
                ready = self.table("embeddings").join(ent.where("embedding_status = 'ready'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
                sem = hybrid.ranked(vector.knn(ready, self.embedder()([query_keywords])[0].tolist(), at + limit, "entity_id"), [F.col("distance"), F.col("id")], at + limit)
            out = ent.join(F.broadcast(hybrid.fuse(lex, sem, at + limit).select("id", F.col("rrf").alias("score"), "l", "s")), "id")  # at + limit rows
            order = [F.desc("score"), F.asc_nulls_last("l"), F.asc_nulls_last("s"), F.col("id")]
        page = hybrid.page(out, order, limit, at)
        cols = ["id", "title", X.snippet(F.col("full_content")).alias("snippet"), F.round(F.abs("score"), 6).alias("score"), "weight", "is_core", "cursor"]
        if not include_related:
            return page.select(*cols)
        hits = checkpointed(page)  # limit rows
        related = hybrid.neighbours(hits, self.table("relations").where(hybrid.valid_at(self.now())), self.table("entities")).withColumnRenamed("id", "of")
        return hits.join(related, F.col("id") == F.col("of"), "left").orderBy(*order).select(*cols, "related")

    def find(self, q=None) -> DataFrame:
        """The best twenty hits."""
        return self.search_memory(q, limit=FOUND, include_related=False)

    # Lists
    def list_entities(self, page=1, owner_id=None, status=None, context_id=None, is_core=None, tags=None) -> tuple[DataFrame, DataFrame]:
        """(page, totals); tags: one tag by its exact name."""
        return report.entity_list(self.table("entities"), self.table("entity_tags"), self.table("tags"), page, tags, owner=owner_id, status=status, context=context_id, is_core=is_core)

    def list_relations(self, page=1, predicate=None) -> tuple[DataFrame, DataFrame]:
        return report.relation_list(self.table("relations"), self.table("entities"), page, predicate)

    def lineage(self, entity_id) -> tuple[DataFrame, DataFrame] | None:
        """(nodes, edges) of the row that the text means, by its id or title or a part of it; None if there is none."""
        row = graph.fuzzy(self.table("entities"), entity_id).select("id").first()
        return graph.lineage_graph(self.table("entities"), self.table("relations"), row["id"]) if row else None

    def neighbourhood(self, entity_id) -> DataFrame:
        """(id, near) of one row: itself and the other ends of its edges."""
        return graph.one_hop(self.table("relations"), self._resolved(entity_id).select("id"))

    def overview(self, query_keywords=None) -> DataFrame:
        """Rows by status, core rows, the latest events and the best hits of a query; nothing is written."""
        return report.overview(self.table("entities"), self.table("events"), self.texts.search(query_keywords)[0])

    def _explained(self, query: str | None, tags: list[str] | None) -> DataFrame:
        """(term, found) of the query's words as the search reads them, and of unknown tags."""
        out = self.texts.explain(query)
        return out.unionByName(lexical.unknown_tags(self.table("tags"), tags)) if tags else out

    def explain(self, query_keywords=None, owner_id=None, tags_filter=None, metadata_filter=None, context_id=None, is_core=None, tag_operator="AND", project_id=None) -> dict:
        """What a search makes of its parameters: the cleaned query, which of its words are found, tags that aren't known, and the conditions that hits must meet."""
        tags = as_list(tags_filter)
        rows = self._explained(query_keywords, tags).collect()  # a row for each word and tag of one query
        unknown = {t for t in tags or []}
        clauses = [("status", "not archived"), ("visible to", owner_id), ("context", context_id), ("project", project_id), ("is_core", is_core), ("metadata", metadata_filter), (f"tags ({tag_operator})", tags)]
        return {
            "sanitized_query": lexical.sanitize_query(query_keywords), "searched_terms_found": {r["term"]: r["found"] for r in rows if r["term"] not in unknown or r["found"]},
            "invalid_tags": [r["term"] for r in rows if r["term"] in unknown and not r["found"]], "conditions": {k: v for k, v in clauses if v is not None and v != []},
        }

    def archive_memory(self, entity_id, owner_id=None):
        return self.bulk_archive_memory([(entity_id, owner_id)])[entity_id]

    def bulk_archive_memory(self, archive_requests) -> dict:
        pairs = [(r, None) if isinstance(r, str) else tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in archive_requests]
        since = snapshot.state(self.spark, self.root)[0]
        asked = self.spark.createDataFrame(pairs, "input string, owner_id string")
        ids = graph.resolve_ids(asked.select("input").distinct(), self.table("entities"))
        asked = checkpointed(asked.join(ids, "input"))
        ent, result = scd.archive(self.table("entities"), asked.select("id", "owner_id"), self.now())
        out = {r["input"]: r["result"] for r in asked.select("input", "id").join(result, "id").collect()}
        self._save(since, entities=ent)
        return out

    def check_duplicate_memories(self, title=None, content=None, owner_id=None, exclude_ids=None) -> DataFrame:
        live = self.table("entities").where(hybrid.active())
        live = live.where(F.col("owner_id").isNull() | (F.col("owner_id") == owner_id)) if owner_id is not None else live
        live = live.where(~F.col("id").isin(exclude_ids)) if exclude_ids else live
        new = self.spark.createDataFrame([("new", title, content)], "id string, title string, full_content string")
        found = self.contents.overlaps(new.select("id", X.content_tokens(content_field()["content"]).alias("tokens")), dedup.NEAR)
        return found.join(live.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("b").alias("id"), "similarity").orderBy(F.desc("similarity"), "id")

    def detect_orphaned_memories(self, owner_id=None) -> DataFrame:
        return graph.orphans(self.table("entities"), self.table("relations"), owner_id)

    def get_canonical_tags(self, domain=None) -> DataFrame:
        return tagging.canonical(self.table("tags"), domain)

    # Graph
    def store_relation(self, source_id, target_id, predicate):
        return self.bulk_store_relations([(source_id, target_id, predicate)])[0]

    def bulk_store_relations(self, relations) -> list[str]:
        rows = [(i, *(r.values() if isinstance(r, dict) else r)) for i, r in enumerate(relations)]
        asked = self.spark.createDataFrame(rows, "seq long, source_id string, target_id string, predicate string")
        since, ent = snapshot.state(self.spark, self.root)[0], self.table("entities")
        for side in ("source_id", "target_id"):
            found = graph.resolve_ids(asked.select(F.col(side).alias("input")).distinct(), ent).select("input", F.col("id").alias("found"))
            asked = asked.join(found, F.col(side) == F.col("input")).withColumn(side, F.col("found")).drop("input", "found")
        rel, result = scd.add_relations(self.table("relations"), ent, asked, self.now())
        out = {r["seq"]: r["result"] for r in result.collect()}
        self._save(since, relations=rel)
        return [out[i] for i in range(len(rows))]

    def analyze_dependencies(self, root_entity_id, max_depth=5) -> DataFrame:
        found = self._resolved(root_entity_id).select("id").first()
        root = found["id"] if found else root_entity_id
        return graph.paths_to(graph.depths(self.table("relations"), root, self.now(), max_depth), self.table("entities"), root).orderBy("depth", "id")

    def analyze_lineage(self, entity_id) -> DataFrame:
        return graph.lineage_by_parents(self.table("entities"), entity_id)

    def commit_consolidation(self, parent_ids, title, content, tags=None, scope="shared", weight=1, owner_id=None, context_id=None) -> dict:
        return self.bulk_commit_consolidation([{"parent_ids": parent_ids, "title": title, "content": content, "tags": tags, "scope": scope, "weight": weight, "owner_id": owner_id, "context_id": context_id}])[0]

    def bulk_commit_consolidation(self, consolidations) -> list[dict]:
        """result (stored, or why not), id and similar_to of each."""
        rows = [(i, list(c["parent_ids"] or []), c["title"], c["content"], c.get("owner_id"), c.get("scope"), c.get("weight"), c.get("context_id")) for i, c in enumerate(consolidations)]
        asked = self.spark.createDataFrame(rows, "seq long, parent_ids array<string>, title string, full_content string, owner_id string, scope string, weight int, context_id string")
        since = snapshot.state(self.spark, self.root)[0]
        ent, rel, result = consolidation.consolidate(self.table("entities"), self.table("relations"), asked, self.now(), self.rules)
        result = checkpointed(result)
        out = {"entities": ent, "relations": rel}
        if names := [(i, t) for i, c in enumerate(consolidations) for t in as_list(c.get("tags")) or []]:
            tags = self.spark.createDataFrame(names, "seq long, name string")
            ok = result.where("result = 'stored'").join(tags, "seq").select(F.col("id").alias("entity_id"), "name")
            out["tags"], out["entity_tags"] = tagging.link(self.table("tags"), self.table("entity_tags"), ok)
        self._save(since, **out)
        return [r.asDict() for r in result.orderBy("seq").drop("seq").collect()]

    # The rest
    def store_ephemeral_memory(self, key, value):
        self.ephemeral.put(key, value)

    def get_ephemeral_memory(self, key):
        return self.ephemeral.get(key)

    def locks(self) -> DataFrame:
        """Tasks with their locks and last runs."""
        return listing(self.spark, f"{self.root}/locks")

    def stats(self) -> DataFrame:
        """Counts, with the store's size in bytes by its live files."""
        sizes = snapshot.size(self.spark, self.root)
        return report.stats(self.table("entities"), self.table("events"), self.table("relations"), self.table("tags")).withColumn("store_bytes", F.lit(sum(sizes.values())).cast("long"))

    def compact(self) -> int:
        """Every table as one base without deltas."""
        return snapshot.compact(self.spark, self.root)

    def create_snapshot(self):
        return snapshot.backup(self.spark, self.root, f"{self.root}/backups")

    def backfill_embeddings(self, retry: bool = False) -> None:
        since = snapshot.state(self.spark, self.root)[0]
        ent, emb = backfill(self.table("entities"), self.table("embeddings"), self.embedder, retry)
        self._save(since, entities=ent, embeddings=emb)

    def triggered(self, stream: str, batch: int, events: int) -> bool:
        """Takes note of a stream's batch of so many events, and runs the librarian if it is due. A batch that is replayed counts once: what it led to
        and its number are one commit."""
        noted = snapshot.state(self.spark, self.root)[1].get("triggers", {})
        mine = noted.get(stream, {"batch": -1, "events": 0})
        if batch <= mine["batch"]:
            return False
        waiting = mine["events"] + events
        after = lambda left: {"triggers": noted | {stream: {"batch": batch, "events": left}}}
        if waiting and self.run_librarian(extra=after(0)):
            return True
        self._save(extra=after(waiting))
        return False

    def run_librarian(self, distance: float = librarian.NEAR, extra: dict | None = None) -> bool:
        """False if it isn't due or another process is at it. extra: what its commit keeps besides."""
        ent = self.table("entities")
        if not librarian.due(ent.where("status = 'raw'").limit(2).count(), self.lock.seconds_since_last()) or not self.lock.acquire():
            return False
        try:
            since = snapshot.state(self.spark, self.root)[0]
            tags, links, requests = librarian.run(ent, self.table("tags"), self.table("entity_tags"), self.table("embeddings"), self.now(), distance)
            self._save(since, extra, tags=tags, entity_tags=links, events=checkpointed(requests))
        finally:
            self.lock.release()
        return True
