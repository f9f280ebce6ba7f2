import pytest

from tessera.plans.locks import Ephemeral, JobLock
from tessera.plans.service import Store, parameters

NOTE = "Deploy the service with the release script and check the logs of {0} after the restart of the {0} workers in the cluster."


def test_tools(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a = s.call("store_memory", text=NOTE.format("alpha"), title="Alpha", owner="o", tags=["Run-Book", "ops"])
    assert a["result"] == "stored"
    assert s.store_memory(NOTE.format("alpha"), "Other", owner_id="o")["result"] == "exact duplicate"
    assert s.store_memory("tiny", "T", owner_id="o")["result"] == "quality: SHORT_LENGTH"
    assert s.store_memory(NOTE.format("alpha") + " Then tell the owners of the alpha queue about it.", "Alpha", owner_id="o") == {"result": "updated", "id": a["id"]}
    b = s.store_memory("Database backups run each night on the second host and the results are kept for ten days in the archive.", "Beta", owner_id="o", skip_duplicate_check=True)
    assert b["result"] == "stored" and s.table("entities").where("status = 'archived'").count() == 1
    assert s.store_relation("Beta", "Alpha", "depends_on") == "stored" and s.store_relation("Beta", "Beta", "x") == "self-loop"
    s.backfill_embeddings()
    assert [r["id"] for r in s.search_memory("restarting workers", limit=1).collect()] == [a["id"]]
    assert [r["id"] for r in s.search_memory("backup", tags_filter=["runbook"], semantic=False).collect()] == []
    assert [r["id"] for r in s.search_memory(tags_filter=["runbook"]).collect()] == [a["id"]]
    assert [r["id"] for r in s.analyze_dependencies("Beta").collect()] == [a["id"]]
    assert s.fetch_memory_chunk("Beta").startswith("Database")
    assert [r["id"] for r in s.call("search_memory", tag="runbook").collect()] == [a["id"]] == [r["id"] for r in s.call("search_memory", tags="run-book, ops").collect()]
    assert s.search_memory("___").count() <= 2
    hit = s.search_memory("backup", semantic=False, include_related=True).first()
    assert hit["id"] == b["id"] and [(x["id"], x["predicate"]) for x in hit["related"]] == [(a["id"], "depends_on")]
    secret = "ghp_" + "b" * 36
    assert s.commit_consolidation([a["id"]], "None", "ok")["result"] == "quality: SHORT_LENGTH" and s.commit_consolidation(["nope"], "None", NOTE.format("gamma"))["result"] == "no parent found"
    assert s.commit_consolidation([b["id"]], "Same", NOTE.format("alpha") + " Then tell the owners of the alpha queue about it.", owner_id="o")["result"] == f"exact duplicate of {a['id']}"
    made = s.commit_consolidation([a["id"], "Beta"], "Both", f"All of the release and backup notes together in one place, with the key {secret} that nobody should read.", tags="joint,#ops", context_id="ctx")
    c = made["id"]
    row = s.table("entities").where(f"id = '{c}'").first()
    assert made["result"] == "stored" and secret not in row["full_content"] and row["context_id"] == "ctx" and row["quality_status"] == "ACCEPT" and row["content_hash"] and sorted(row["parent_ids"]) == sorted([a["id"], b["id"]])
    assert [r["id"] for r in s.search_memory(tags_filter=["joint", "ops"]).collect()] == [c]
    assert {r["status"] for r in s.table("entities").where(f"id = '{a['id']}'").collect()} == {"archived"} and [r["id"] for r in s.analyze_lineage(c).where("depth = 1").orderBy("id").collect()] == sorted([a["id"], b["id"]])
    s.log_event(message := "seen ghp_" + "a" * 36, agent_id="me")
    assert message not in s.get_recent_events("me").first()["content"]
    s.log_event('{"target": "general", "entity_ids": ["' + c + '"]}', agent_id="lib", type="consolidation_request")
    assert [(r["type"], r["status"]) for r in s.get_recent_events().collect()] == [("consolidation_request", "resolved"), ("event", None)]
    assert s.archive_memory("Both") == "archived" and s.archive_memory("nope") == "not found" and s.run_librarian() is False


def test_supersession(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    text = " ".join(f"topic{chr(97 + i)}{chr(122 - i)} with" for i in range(26))
    old = s.store_memory(text, "Plan", owner_id="o", weight=4)
    new = s.store_memory(text + " and more", "Newer plan", owner_id="o")
    assert (old["result"], new["result"]) == ("stored", "supersedes")
    assert {r["id"]: r["weight"] for r in s.table("entities").collect()}[old["id"]] == 1 and s.table("relations").first()["predicate"] == "supersedes"


def test_small_parts(spark, tmp_path):
    lock, other = JobLock(spark, str(tmp_path)), JobLock(spark, str(tmp_path))
    assert lock.acquire(1000.0) and not other.acquire(1100.0) and other.acquire(1700.0)
    other.release(1800.0)
    assert lock.acquire(1801.0) and lock.seconds_since_last(1900.0) == 100.0
    e = Ephemeral()
    e.put("k", "v")
    assert e.get("k") == "v" and e.get("x") is None
    with pytest.raises(ValueError):
        e.put("", "v")
    assert parameters({"q": "x", "query_keywords": "y"}, {"query_keywords"}) == {"query_keywords": "y"}
    with pytest.raises(TypeError):
        parameters({"zzz": 1}, {"query_keywords"})


def test_lists(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    assert s.lineage("nothing") is None and {r["section"] for r in s.overview("x").collect()} == set()
    a = s.store_memory(NOTE.format("alpha"), "Alpha", owner_id="o", tags=["ops"], is_core=True, weight=4)["id"]
    b = s.store_memory("Database backups run each night on the second host and the results are kept for ten days in the archive.", "Beta", owner_id="p", skip_duplicate_check=True)["id"]
    s.store_relation("Beta", "Alpha", "depends_on")
    c = s.commit_consolidation([a], "Joint", "All of the release notes of the service are in one place now, with the names of those who keep them.")["id"]
    s.log_event("x" * 100, agent_id="me")
    s.log_event('{"target": "tag", "tag_name": "#ops", "entity_ids": []}', agent_id="lib", type="consolidation_request")
    page, total = s.list_entities(page="x", tags="#ops")
    assert [(r["id"], r["embedding_status"], r["tags"]) for r in page.collect()] == [(a, "archived", ["#ops"])] and total.first()["total"] == 1
    assert s.list_entities(tags="ops")[0].count() == 0 and {r["embedding_status"] for r in s.list_entities(status="raw")[0].collect()} == {"pending"}
    page, total = s.list_relations(predicate="consolidated_from")
    assert [(r["source_title"], r["target_title"]) for r in page.collect()] == [("Joint", "Alpha")] and s.list_relations(9)[0].count() == 0 and s.list_relations(9)[1].first()["total"] == 2
    nodes, edges = s.lineage("joi")
    assert [(r["id"], r["depth"]) for r in nodes.orderBy("depth").collect()] == [(c, 0), (a, 1)] and [(r["source_id"], r["target_id"]) for r in edges.collect()] == [(c, a)]
    assert {r["near"] for r in s.neighbourhood(b).collect()} == {b, c}
    seen = {(r["section"], r["label"], r["detail"]) for r in s.overview("backups").collect()}
    assert ("event", "lib CONSOLIDATION_REQUEST", "Consolidation request for tag #ops") in seen and ("event", "me EVENT", "x" * 80 + "...") in seen
    assert {x[1] for x in seen if x[0] == "search"} == {"Beta"} and {x[1] for x in seen if x[0] == "status"} == {"RAW", "CONSOLIDATED", "ARCHIVED"}
    s.backfill_embeddings()
    assert s.find("zzzz").count() > 0
    monkeypatch.setenv("TESSERA_SEMANTIC", "Off")
    assert s.find("zzzz").count() == 0 and [r["id"] for r in s.find("backups").collect()] == [b]
