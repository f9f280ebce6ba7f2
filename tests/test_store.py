import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import dedup, events, graph, hybrid, report, scd, vector
from tessera.operators import tags as tagging
from tessera.plans import librarian, locks
from tessera.sources import commits, importers, snapshot
from tessera.streaming import ledger

def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


T0 = dt.datetime(2024, 1, 1)


def entities(spark, *rows):
    base = {f: None for f in schema.TABLES["entities"].fieldNames()} | {"created_at": T0, "updated_at": T0, "owner_id": "o", "scope": "shared", "status": "raw", "weight": 1, "is_core": False, "parent_ids": [], "embedding_status": "ready", "full_content": "text"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema.TABLES["entities"])


def edges(spark, *pairs):
    return spark.createDataFrame([(f"e{i}", a, b, p, T0, None, None) for i, (a, b, p) in enumerate(pairs)], schema.TABLES["relations"])


def test_upsert_keeps_history(spark):
    old = entities(spark, {"id": "a", "title": "one", "parent_ids": ["p"], "project_id": "x"}, {"id": "b"})
    new = entities(spark, {"id": "a", "title": "two", "owner_id": None, "parent_ids": []}, {"id": "c"})
    out = {r["id"]: r for r in scd.upsert(old, new, now()).collect()}
    assert len(out) == 4 and out["a"]["title"] == "two" and out["a"]["parent_ids"] == ["p"] and out["a"]["owner_id"] == "o" and out["a"]["project_id"] == "x"
    past = next(r for k, r in out.items() if k.startswith("a_h_"))
    assert past["status"] == "archived" and past["valid_to"] == out["a"]["valid_from"] and past["valid_from"] == T0 and out["c"]["status"] == "raw"


def test_archive_and_relations(spark):
    ent = entities(spark, {"id": "a"}, {"id": "b", "status": "archived"}, {"id": "c"})
    asked = spark.createDataFrame([("a", "o"), ("b", None), ("c", "z"), ("d", None)], "id string, owner_id string")
    after, result = scd.archive(ent, asked, now())
    assert dict(result.collect()) == {"a": "archived", "b": "already archived", "c": "not the owner", "d": "not found"}
    assert {r["id"]: r["status"] for r in after.collect()} == {"a": "archived", "b": "archived", "c": "raw"}
    req = spark.createDataFrame([(1, "a", "c", "p"), (2, "a", "a", "p"), (3, "a", "x", "p"), (4, "x", "a", "p")], "seq long, source_id string, target_id string, predicate string")
    rel, result = scd.add_relations(edges(spark, ("a", "b", "q")), ent, req, now())
    assert dict(result.collect()) == {1: "stored", 2: "self-loop", 3: "no target", 4: "no source"} and rel.count() == 2


def test_consolidate(spark):
    ent = entities(spark, {"id": "a"}, {"id": "b"}, {"id": "c"})
    req = spark.createDataFrame([("n", ["a", "b", "zz"], "T", "merged", None, "shared", 2)], "id string, parent_ids array<string>, title string, full_content string, owner_id string, scope string, weight int")
    after, rel = scd.consolidate(ent, edges(spark, ("a", "c", "p"), ("a", "b", "p"), ("c", "b", "q")), req, now())
    rows = {r["id"]: r for r in after.collect()}
    assert rows["n"]["status"] == "consolidated" and rows["n"]["owner_id"] == "system" and rows["a"]["status"] == "archived" and rows["c"]["status"] == "raw"
    assert sorted((r["source_id"], r["target_id"], r["predicate"]) for r in rel.collect()) == [("c", "n", "q"), ("n", "a", "consolidated_from"), ("n", "b", "consolidated_from"), ("n", "c", "p")]


def test_graph(spark):
    ent = entities(spark, *[{"id": x, "title": x.upper()} for x in ("e1", "e10", "e2", "lone")])
    rel = edges(spark, ("e1", "e10", "p"), ("e10", "e2", "p"), ("e2", "e1", "p"))
    paths = graph.closure(rel, "e1", now())
    assert sorted(r["target_id"] for r in paths.collect()) == ["e10", "e2"]
    assert {r["id"]: r["depth"] for r in graph.depths(rel, "e1", now()).collect()} == {"e10": 1, "e2": 2}
    assert "E1 -> E10 -> E2" in {r["titles"] for r in graph.path_titles(paths, ent).collect()}
    assert [r["id"] for r in graph.orphans(ent, rel).collect()] == ["lone"]
    assert graph.with_least_degree(rel, 2).count() == 3
    assert graph.fuzzy(ent, "e10").first()["id"] == "e10"
    back = edges(spark, ("n", "m", "consolidated_from"), ("m", "k", "consolidated_from"))
    assert {(r["id"], r["depth"]) for r in graph.lineage_by_edges(back, "n").collect()} == {("n", 0), ("m", 1), ("k", 2)}


def test_fusion(spark):
    lists = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "id string, rank int") for xs in (["A", "B", "C"], ["B", "D", "A"])]
    assert [r["id"] for r in hybrid.fuse(*lists, 4).collect()] == ["B", "A", "D", "C"]
    assert hybrid.decode_cursor("offset:7") == 7 and hybrid.decode_cursor("x") == 0 and report.page_of("x") == 1 and report.page_of("-3") == 1


def test_tags(spark):
    tags = spark.createDataFrame([("1", "#Foo-Bar", None, T0), ("2", "#foo_bar", None, T0 + dt.timedelta(1)), ("3", "#other", None, T0)], schema.TABLES["tags"])
    links = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2")], schema.TABLES["entity_tags"])
    folded, moved = tagging.merge(tags, links)
    assert {r["id"]: r["canonical_id"] for r in folded.collect()} == {"1": None, "2": "1", "3": None}
    assert sorted(map(tuple, moved.collect())) == [("a", "1"), ("b", "1")]
    made, linked = tagging.link(folded, moved, spark.createDataFrame([("c", "foobar"), ("c", "new"), ("d", "#foo_bar")], "entity_id string, name string"))
    assert made.count() == 4 and {(r[0], r[1]) for r in linked.collect()} >= {("c", "1"), ("d", "1")}
    assert hybrid.with_tags(linked, made, ["nope"]).count() == 0
    assert [r["id"] for r in hybrid.with_tags(linked, made, ["foo bar", "new"], "AND").collect()] == ["c"]


def test_token_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = [(i, sorted(rng.sample("abcdefghij", rng.randint(0, 6)))) for i in range(40)]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.token_pairs(df, df, 0.4, same=F.col("a") < F.col("b")).collect()}
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in sets for j, y in sets if i < j and x and y}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.4})


@pytest.mark.parametrize("least", [0.25, 0.88])
def test_similar_sets_over_a_grid(spark, monkeypatch, least):
    """Sets of very unequal sizes in many blocks, copies among them, of one table and of two; no candidate or whole set is joined."""
    import random

    from tessera.operators import similar_sets

    monkeypatch.setattr(similar_sets, "LEAST_BLOCK", 400)
    monkeypatch.setattr(similar_sets, "FREQUENT", 20)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(70)]
    among = [rng.choice([6, 20, 70]) for _ in range(150)]
    sets = [(f"k{i:03}", sorted(rng.sample(words[:m], min(m, rng.choice([0, 1, 3, 6, 15, 40]))))) for i, m in enumerate(among)]
    sets += [(f"c{i:03}", sets[i % 4 + 21][1]) for i in range(30)]
    schema = "id string, tokens array<string>"
    df, other = spark.createDataFrame(sets, schema), spark.createDataFrame(sets[:60] + [("new", ["w1", "w2"])], schema)

    def want(xs, ys):
        return {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in xs for j, y in ys if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}

    def got(pairs):
        rows = [(r["a"], r["b"], r["similarity"]) for r in pairs.collect()]
        assert len(rows) == len({x[:2] for x in rows})
        return {x[:2]: x[2] for x in rows}

    assert got(similar_sets.similar_pairs(df, df, least)) == want(sets, sets)
    assert got(similar_sets.similar_pairs(df, other, least)) == want(sets, sets[:60] + [("new", ["w1", "w2"])])
    assert got(similar_sets.similar_pairs(other, df.limit(0), least)) == {}
    plan = dedup.token_pairs(df, df, least)._jdf.queryExecution().toString()
    assert "explode" not in plan and "array_intersect" not in plan


def test_events(spark):
    made = events.event(spark.createDataFrame([("a", "x" * 1500, "note"), ("a", '{"entity_ids": ["e"]}', events.REQUEST)], "agent_id string, content string, type string"), now())
    got = {r["type"]: r["content"] for r in events.recent(made).collect()}
    assert got["note"].endswith(" [TRUNCATED]") and len(got["note"]) == 1012 and got[events.REQUEST].startswith("{")
    req = spark.createDataFrame([("1", '{"entity_ids": ["e"]}'), ("2", '{"entity_ids": ["gone"]}'), ("3", "not json"), ("4", '{"entity_ids": []}')], "id string, content string")
    assert dict(events.request_status(req, entities(spark, {"id": "e"})).collect()) == {"1": "pending", "2": "resolved", "3": "pending", "4": "resolved"}


def test_librarian(spark):
    ids = [f"e{i}" for i in range(6)]
    ent = entities(spark, *[{"id": i, "title": i} for i in ids], {"id": "c", "status": "consolidated", "title": "C", "valid_from": T0 - dt.timedelta(1)})
    emb = spark.createDataFrame([(i, [1.0, 0.01 * n]) for n, i in enumerate([*ids, "c"])], schema.TABLES["embeddings"])
    none = schema.empty(spark, "tags"), schema.empty(spark, "entity_tags")
    *_, req = librarian.run(ent, *none, emb, now())
    targets = sorted(F.get_json_object("content", "$.target") is not None and r["t"] for r in req.select(F.get_json_object("content", "$.target").alias("t")).collect())
    assert targets == ["general", "supersession_candidate", "vector_cluster"]
    old = entities(spark, {"id": "s", "quality_score": 0.2}, {"id": "k", "quality_score": 0.2, "is_core": True}, {"id": "p", "quality_score": 0.2, "metadata": '{"is_pinned": true}'})
    assert [r["id"] for r in librarian.decayed(old, now()).collect()] == ["s"]
    assert librarian.due(2, None) and not librarian.due(2, 10) and not librarian.due(1, None)


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "id long, embedding array<float>")
    assert [r["id"] for r in vector.knn(v, [1.0, 0.0], 2).collect()] == [1, 3]


def test_importers(spark):
    f = spark.createDataFrame([("f", "intro\n## One\nbody\n### Two\nmore\n## Empty\n- [DECISION] use it\n* [fact]: skip this\n| a.md | 2024-01-02 | x |")], "path string, text string")
    assert [(r["title"]) for r in importers.sections(f).orderBy("pos").collect()] == ["One", "Two", "Empty"]
    assert [(r["type"], r["content"]) for r in importers.log_events(f, phrases=["skip"]).collect()] == [("decision", "use it")]
    assert [(r["file"], r["date"]) for r in importers.catalog_rows(f).collect()] == [("a.md", "2024-01-02")]


def test_snapshots_and_stream(spark, tmp_path):
    root = str(tmp_path)
    assert snapshot.read(spark, root, "entities").count() == 0
    snapshot.write(entities(spark, {"id": "a"}), root, "entities")
    assert snapshot.write(entities(spark, {"id": "a"}, {"id": "b"}), root, "entities") == 2
    assert snapshot.read(spark, root, "entities").count() == 2 and snapshot.read(spark, root, "entities", 1).count() == 1
    assert snapshot.read(spark, snapshot.backup(spark, root, f"{root}/backup"), "entities").count() == 2
    rows = [(str(i % 3), T0 + dt.timedelta(hours=i), "a", "note", "", None, None, None) for i in range(6)]
    for at in (rows[:1], rows, []):
        snapshot.write(spark.createDataFrame(at, schema.TABLES["events"]), root, "events")
    assert [snapshot.read(spark, root, "events", v).count() for v in (2, 3, 4, 5)] == [0, 1, 1 + len(rows), 1 + len(rows)]
    again = snapshot.backup(spark, root, f"{root}/backup-2")
    assert snapshot.versions(spark, again) == [1] and snapshot.read(spark, again, "events").count() == 1 + len(rows)
    ledger.write(ledger.read_ledger(spark, root), f"{root}/out", f"{root}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 3


def test_changed_rows_take_the_place_of_the_bases(spark, tmp_path):
    root, rows = str(tmp_path), {f"k{i}": i % 5 for i in range(20)}
    table = lambda d: entities(spark, *[{"id": k, "weight": w} for k, w in d.items()])
    read = lambda: {r["id"]: r["weight"] for r in snapshot.read(spark, root, "entities").collect()}
    snapshot.write(table(rows), root, "entities")
    rng = __import__("random").Random(1)
    for step in range(20):  # more than FAN, so deltas are merged on the way
        change = {f"k{rng.randrange(30)}": rng.randrange(9) for _ in range(2)}
        gone = [f"k{rng.randrange(30)}"] if step % 3 == 0 else []
        snapshot.commit(spark, root, changed={"entities": table(change)}, gone={"entities": spark.createDataFrame([(k,) for k in gone], "id string")} if gone else None)
        rows = {k: v for k, v in (rows | change).items() if k not in gone}
    assert read() == rows and len(snapshot.state(spark, root)[1]["tables"]["entities"]["deltas"]) < snapshot.FAN
    snapshot.compact(spark, root)
    assert read() == rows and not snapshot.state(spark, root)[1]["tables"]["entities"]["deltas"]
    before, after = table({"a": 1, "b": 2, "c": 3}), table({"a": 1, "b": 5, "d": 4})
    changed, gone = snapshot.changes(before, after, "entities")
    assert {r["id"] for r in changed.collect()} == {"b", "d"} and [r["id"] for r in gone.collect()] == ["c"]


def test_a_stopped_writer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    snapshot.commit(spark, root, replaced={"entities": entities(spark, {"id": "a"}), "relations": edges(spark, ("a", "a", "p"))})
    with monkeypatch.context() as m:
        m.setattr(commits.Commits, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            snapshot.commit(spark, root, changed={"entities": entities(spark, {"id": "b"}), "relations": edges(spark, ("b", "a", "p"))}, added={"touches": spark.createDataFrame([("a", T0)], schema.TABLES["touches"])})
    assert snapshot.read(spark, root, "entities").count() == 1 == snapshot.read(spark, root, "relations").count() and snapshot.versions(spark, root) == [1]
    snapshot.commit(spark, root, changed={"entities": entities(spark, {"id": "c"})}, since=1)
    with pytest.raises(snapshot.Conflict):
        snapshot.commit(spark, root, changed={"entities": entities(spark, {"id": "d"})}, since=1)
    snapshot.commit(spark, root, added={"touches": spark.createDataFrame([("a", T0 + dt.timedelta(days=900))], schema.TABLES["touches"])}, since=1)
    assert {r["id"]: r["last_accessed_at"] for r in snapshot.read(spark, root, "entities").collect()}["a"] == T0 + dt.timedelta(days=900)


def test_many_small_appends_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "FAN", 4)
    monkeypatch.setattr(snapshot, "KEPT", 2)
    root = str(tmp_path)
    for i in range(50):
        snapshot.write(spark.createDataFrame([(str(i), T0, "a", "note", "", None, None, None)], schema.TABLES["events"]).coalesce(1), root, "events")
    deltas = snapshot.state(spark, root)[1]["tables"]["events"]["deltas"]
    assert snapshot.read(spark, root, "events").count() == 50 and len(deltas) <= 8
    snapshot.vacuum(spark, root, 1)
    files = list(tmp_path.glob("data/**/*.parquet"))
    assert len(files) <= 12 and snapshot.read(spark, root, "events").count() == 50
    assert snapshot.size(spark, root)["events"] == sum(f.stat().st_size for p, _ in deltas for f in (tmp_path / p).rglob("*") if f.is_file() and not f.name.endswith(".crc"))


def test_one_of_several_writers_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = commits.Commits(spark, f"{tmp_path}/log")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.commit(1, {"by": i}), range(8)))
    assert sum(won) == 1 and log.last() == (1, {"by": won.index(True)}) and log.numbers() == [1]
    locks_ = [locks.JobLock(spark, f"{tmp_path}/locks") for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda x: x.acquire(1000.0), locks_)) == 1
        assert sum(pool.map(lambda x: x.acquire(1700.0), locks_)) == 1
    (row,) = locks.listing(spark, f"{tmp_path}/locks").collect()
    owner = next(x for x in locks_ if x.owner == row["locked_by"])
    assert row["task_name"] == "librarian_consolidation" and row["last_run_at"] is None and row["locked_at"] is not None
    assert [x.release(1800.0) for x in locks_].count(True) == 1 and owner.seconds_since_last(1900.0) == 100.0
    (row,) = locks.listing(spark, f"{tmp_path}/locks").collect()
    assert row["locked_by"] is None and row["last_run_at"] is not None


def test_input_errors(spark):
    rows = [("o", "shared", "t", "c", None), (None, "shared", "t", "c", None), ("o", "shared", "a.md - t", "c", None), ("o", "shared", "t", "c", '{"source_path": "/home/x"}'), ("o", "x", "t", "c", None), ("o", "shared", " ", "c", None)]
    df = spark.createDataFrame(rows, "owner_id string, scope string, title string, full_content string, metadata string")
    assert [r[0] for r in df.select(scd.input_error(df)).collect()] == [None, "owner_id is missing", "title begins with a file name", "source_path is absolute", "scope is unknown", "title is blank"]


def test_pairs_over_blocks_and_strips(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "STRIP", 7)
    monkeypatch.setattr(vector, "BLOCK", 9)
    v = np.random.default_rng(1).normal(size=(60, 3))
    v[5] = 0
    rows = spark.createDataFrame([(f"k{i}", [float(x) for x in r]) for i, r in enumerate(v)], "id string, embedding array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = {(f"k{i}", f"k{j}") for i in range(60) for j in range(60) if 1 - unit[i] @ unit[j] <= 0.1}
    cells = vector.Cells(rows, 0.1, "id", "embedding")
    assert len(cells.centres) == 7 and cells.blocks.max() > 1
    assert {(r["a"], r["b"]) for r in vector.pairs_within(rows, rows, 0.1).collect()} == want
    once = [(r["a"], r["b"]) for r in vector.pairs_among(rows, 0.1).collect()]
    assert len(once) == len(set(once)) and set(once) == {(a, b) for a, b in want if a < b}


def test_greedy_clusters_along_a_chain(spark):
    n = 40
    near = {i: [j for j in range(n) if abs(i - j) <= 1] for i in range(n)}
    pairs = spark.createDataFrame([(f"{i:02}", f"{j:02}") for i in near for j in near[i]], "a string, b string")
    taken, want = set(), {}
    for i in range(n):
        if i not in taken and len(near[i]) >= 3:
            taken.update(near[i])
            want[f"{i:02}"] = [f"{j:02}" for j in near[i]]
    assert {r["seed"]: r["members"] for r in vector.greedy_clusters(pairs).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_greedy_clusters_equal_the_pass(spark, seed):
    import random

    rng = random.Random(seed)
    n = 150
    near = {i: {i} for i in range(n)}
    for _ in range([60, 250, 900][seed]):
        i, j = rng.randrange(n), rng.randrange(n)
        near[i].add(j)
        near[j].add(i)
    taken, want = set(), {}
    for i in range(n):
        if i not in taken and len(near[i]) >= 3:
            taken |= near[i]
            want[i] = sorted(near[i])
    pairs = spark.createDataFrame([(i, j) for i in near for j in near[i]], "a long, b long")
    assert {r["seed"]: r["members"] for r in vector.greedy_clusters(pairs).collect()} == want


def test_a_long_chain_is_in_no_task(spark):
    """100,000 rows in one component: each task settles a range of them."""
    n = 100_000
    ids = spark.range(n)
    pairs = ids.select(F.col("id").alias("a"), F.explode(F.filter(F.array(F.col("id") - 1, F.col("id"), F.col("id") + 1), lambda b: (b >= 0) & (b < n))).alias("b"))
    want, taken = [], -1
    for i in range(1, n - 1):
        if i > taken:
            want.append(i)
            taken = i + 1
    assert sorted(r["a"] for r in vector.seeds(pairs).collect()) == want


def test_cells_prune_and_lose_no_pair(spark):
    """On rows in tight groups the pairs of brute force are found with few copies and products."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    v = np.concatenate([centres[i % 40] + rng.normal(size=24) * 0.08 for i in range(1600)]).reshape(1600, 24)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = 1 - unit @ unit.T <= 0.05
    assert {(r["a"], r["b"]) for r in vector.pairs_among(rows, 0.05).collect()} == {(i, j) for i, j in np.argwhere(near) if i < j}
    cells = vector.Cells(rows, 0.05, "id", "embedding")
    sizes = {r["cell"]: r["count"] for r in cells.residents().groupBy("cell").count().collect()}
    guests = {r["cell"]: r["count"] for r in cells.guests(rows, "id", "embedding", True).groupBy("cell").count().collect()}
    products = sum(n * n // 2 + n * guests.get(c, 0) for c, n in sizes.items())
    # All pairs take 1600 * 1600 / 2 products, and each row sent to all cells after its own some 1600 * 40 / 2 copies.
    assert sum(guests.values()) < 1600 * 40 / 2 / 5 and products < 1600 * 1600 / 2 / 2


@pytest.mark.parametrize("distance", [0.3, 1.0, 1.5])
def test_pairs_at_wide_distances(spark, distance):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(50, 2))
    v[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None)], "id long, embedding array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = {(i, j) for i, j in np.argwhere(1 - unit @ unit.T <= distance)}
    assert {(r["a"], r["b"]) for r in vector.pairs_within(rows, rows, distance).collect()} == want
    assert {(r["a"], r["b"]) for r in vector.pairs_among(rows, distance).collect()} == {(i, j) for i, j in want if i < j}
    assert vector.pairs_among(rows.where("id > 80"), distance).count() == 0


def test_near_pairs_leave_a_task_in_small_batches(monkeypatch):
    """Rows that are all near each other: a block's pairs are never held whole."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(vector, "PAIRS", 1000)
    n = 400
    v = pa.array([[1.0, i / 1e4] for i in range(n)])
    zero = pa.array(np.zeros(n, np.int64))
    batch = [pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(np.full(n, asks)), pa.array(np.arange(n)), v], names=["cell", "x", "y", "asks", "id", "v"]) for asks in (0, 1)]
    made = list(vector._near(batch, 0.5, True))
    assert max(b.num_rows for b in made) <= 1000 and sum(b.num_rows for b in made) == n * (n - 1) // 2


def test_wide_distances_are_compared_in_blocks(spark, monkeypatch):
    """Where every row would be sent to most cells, rows lie in blocks of one cell instead, with the pairs of brute force."""
    import numpy as np

    monkeypatch.setattr(vector, "LEAST_BLOCK", 20)
    v = np.random.default_rng(8).normal(size=(400, 16))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    made = []
    monkeypatch.setattr(vector, "Cells", lambda *a, plain=False, kind=vector.Cells, **k: made.append(plain) or kind(*a, plain=plain, **k))
    got = [(r["a"], r["b"]) for r in vector.pairs_among(rows, 0.7).collect()]
    assert made == [False, True] and len(got) == len(set(got))
    assert set(got) == {(i, j) for i, j in np.argwhere(1 - unit @ unit.T <= 0.7) if i < j}


def test_depths_build_no_paths(spark):
    """A graph of 2**20 paths: each level is its own nodes. Least depths and parents equal a breadth-first search."""
    import collections
    import random

    rng, pairs = random.Random(1), []
    for level in range(20):
        pairs += [(f"{level:02}{a}", f"{level + 1:02}{b}", "p") for a in "xy" for b in "xy"]
    pairs += [(f"{rng.randrange(20):02}x", f"{rng.randrange(20):02}y", "q") for _ in range(8)] + [("00x", "00x", "p"), ("05x", "00x", "p")]
    rel = edges(spark, *pairs)
    want, front = {"00x": (0, None)}, ["00x"]
    for depth in range(1, 13):
        reached = collections.defaultdict(list)
        for a, b, p in pairs:
            if a in front and b not in want:
                reached[b].append((a, p))
        want |= {b: (depth, min(by)) for b, by in reached.items()}
        front = list(reached)
    found = graph.depths(rel, "00x", now(), 12)
    got = {r["id"]: (r["depth"], (r["parent"], r["predicate"])) for r in found.collect()}
    assert got == {k: v for k, v in want.items() if k != "00x"}
    ent = entities(spark, *[{"id": k, "title": k.upper()} for k in want])
    paths = {r["id"]: r["path"] for r in graph.paths_to(found, ent, "00x").collect()}
    assert len(paths) == len(got) and paths["01y"] == "00X -> 01Y" and all(p.count("->") == want[k][0] and p.endswith(k.upper()) for k, p in paths.items())


def test_groups_in_parts(spark):
    rows = [(f"i{i}", "big") for i in range(900)] + [(f"j{i}", None) for i in range(7)] + [("k", "small")]
    out = librarian.in_parts(spark.createDataFrame(rows, "id string, owner_id string"), ["owner_id"], 5, 50).collect()
    assert {(r["owner_id"], r["n"]) for r in out} == {("big", 900), (None, 7)}
    big = [r["entity_ids"] for r in out if r["owner_id"] == "big"]
    assert len(big) == 18 and sorted(x for ids in big for x in ids) == sorted(f"i{i}" for i in range(900)) and max(map(len, big)) < 100


def test_edges_touching_and_one_hop(spark):
    rel = edges(spark, ("a", "b", "p"), ("b", "a", "p"), ("a", "a", "p"), ("c", "a", "q"), ("x", "y", "p"))
    ids = spark.createDataFrame([("a",), ("a",), ("lone",)], "id string")
    assert sorted(r["id"] for r in graph.edges_touching(rel, ids).collect()) == ["e0", "e1", "e2", "e3"]
    assert {(r["id"], r["near"]) for r in graph.one_hop(rel, ids).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("lone", "lone")}
    loop = edges(spark, ("a", "b", "consolidated_from"), ("b", "a", "consolidated_from"), ("z", "b", "consolidated_from"))
    nodes, touching = graph.lineage_graph(entities(spark, {"id": "a"}, {"id": "b"}), loop, "a", max_depth=3)
    assert sorted((r["id"], r["depth"]) for r in nodes.collect()) == [("a", 0), ("a", 2), ("b", 1), ("b", 3)] and touching.count() == 3
