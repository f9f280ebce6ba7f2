"""Stored index, redaction rules, embedding failures, section paths, quality columns and the ledger's trigger."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import embed, quality, redact
from tessera.functions import text as X
from tessera.functions.porter import fts_tokens
from tessera.operators import lexical
from tessera.plans.service import Store
from tessera.sources import importers, index, snapshot
from tessera.streaming import ledger


def fields():
    return {"title": F.col("title"), "content": F.col("text")}


def held(ix):
    return sorted((r["id"], r["field"], r["term"], tuple(r["positions"]), r["len"]) for r in ix.postings().collect())


def by_hand(rows):
    out = []
    for i, (title, text) in rows.items():
        tokens = {"title": fts_tokens(title), "content": fts_tokens(text)}
        n = sum(map(len, tokens.values()))
        out += [(i, f, t, tuple(p for p, x in enumerate(ts) if x == t), n) for f, ts in tokens.items() for t in set(ts)]
    return sorted(out)


def test_upkeep_equals_an_index_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_SEGMENTS", 3)
    rng, rows, ix = random.Random(2), {}, index.TextIndex(spark, str(tmp_path))
    words = "running runs database databases quick node.js Café über the a".split()
    for _ in range(5):
        new = {f"k{rng.randrange(8)}": (rng.choice(words), " ".join(rng.choices(words, k=rng.randrange(6)))) for _ in range(3)}
        gone = [f"k{rng.randrange(8)}"]
        ix.update(spark.createDataFrame([(i, *t) for i, t in new.items()], "id string, title string, text string"), fields(), spark.createDataFrame([(g,) for g in gone], "id string"))
        rows = {i: t for i, t in (rows | new).items() if i in new or i not in gone}
    assert held(ix) == by_hand(rows)
    state = ix.state()
    assert state["rows"] == len(rows) and state["len"] == sum(len(fts_tokens(a)) + len(fts_tokens(b)) for a, b in rows.values()) and len(state["segments"]) <= 4
    ix.compact()
    assert held(ix) == by_hand(rows)
    found = ix.postings(["databas"])
    assert re.search(r"PartitionFilters: \[[^\]]*b#", found._jdf.queryExecution().executedPlan().toString())


def test_phrases_and_explanation_on_stems(spark, tmp_path):
    ix = index.TextIndex(spark, str(tmp_path))
    rows = [("a", "t", "see node.js docs"), ("b", "t", "node and js"), ("c", "node", "js"), ("d", "t", "the node json file"), ("e", "running databases quickly", "")]
    ix.update(spark.createDataFrame(rows, "id string, title string, text string"), fields())
    assert {r["id"] for r in ix.search("node.js")[0].collect()} == {"a", "d"} and {r["id"] for r in ix.search("node js")[0].where("n_terms = 2").collect()} == {"a", "b", "c", "d"}
    assert {r["term"]: r["found"] for r in ix.explain("running + databases quickly zzz node.js js.node").collect()} == {"running": True, "databases": True, "quickly": True, "zzz": False, "node.js": True, "js.node": False}
    df = spark.createDataFrame(rows, "id string, title string, text string")
    posts = lexical.postings(df, "id", fields(), stemmed=True)
    assert all(r["found"] for r in lexical.explain(posts, "running databases quickly", stemmed=True).collect())


def test_overlaps_equal_sets(spark, tmp_path):
    rng, words = random.Random(4), [f"word{i}" for i in range(30)]
    texts = {f"d{i}": " ".join(rng.sample(words, rng.randrange(1, 9))) for i in range(40)}
    ix = index.TextIndex(spark, str(tmp_path), index.CONTENT)
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    ix.update(df.where("id < 'd2'"), {"content": F.col("text")})
    ix.update(df.where("id >= 'd2'"), {"content": F.col("text")})
    new = {"x": "word1 word2 word3 zebra", "y": texts["d7"]}
    asked = spark.createDataFrame(list(new.items()), "id string, text string").select("id", index.CONTENT[0](F.col("text")).alias("tokens"))
    got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in ix.overlaps(asked, 0.25).collect()}
    sims = {(a, b): len(set(s.split()) & set(t.split())) / len(set(s.split()) | set(t.split())) for a, s in new.items() for b, t in texts.items()}
    assert got == {k: round(v, 9) for k, v in sims.items() if v >= 0.25} and got["y", "d7"] == 1


def test_rules_are_checked_by_the_engine_that_runs_them(spark):
    kept, refused = redact.checked_rules(spark, ["# note", "", r"key-(\d)\1", "(?P<x>a)", "a(", r"(?<name>zed)\d", r"key-(\d)\1"])
    assert kept == [r"key-(\d)\1", r"(?<name>zed)\d"] and set(refused) == {"(?P<x>a)", "a("} and all(refused.values())
    df = spark.createDataFrame([("key-11 key-12 ZED7 ghp_" + "a" * 36,)], "t string")
    assert df.select(redact.redact(F.col("t"), kept)).first()[0] == f"{redact.MARK} key-12 {redact.MARK} {redact.MARK}"


def test_a_poison_text_fails_alone():
    sizes = []

    def embedder(texts):
        sizes.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    out = embed._tried(embedder, ["a", "bb", "bad", "cccc", "d"])
    assert [v for v, _ in out] == [[1.0], [2.0], None, [4.0], [1.0]] and [e for _, e in out] == [None, None, "ValueError: no", None, None] and len(sizes) < 9


def test_texts_become_python_objects_a_slice_at_a_time(spark, monkeypatch):
    """The stemmer and the embedder see small slices of an Arrow batch, with the results of the whole."""
    import numpy as np

    from tessera.functions.embed import embed_or_fail

    def make():
        def embed(texts):
            return np.full((len(texts), 1), len(texts), np.float32)

        return embed

    df = spark.range(700).coalesce(1).select(F.concat(F.lit("Nations of "), F.col("id").cast("string")).alias("t")).unionByName(spark.createDataFrame([(None,)], "t string")).coalesce(1)
    sizes = [r["e"]["embedding"][0] for r in df.select(embed_or_fail(F.col("t"), make).alias("e")).collect()]
    assert len(sizes) == 701 and max(sizes) <= 256
    for r in df.select("t", lexical.tokens_of(F.col("t"), True).alias("w")).collect():
        assert r["w"] == fts_tokens(r["t"])


def test_section_paths(spark):
    text = "intro\n## One\nbody\n### Sub [tea]\nx\n```\n## not a header\n### nor this\n```\ny\n### Sub two\nz\n## Two rules\n### Deep\nq\n#### low\nr\n## Empty\n\n## Last\nend"
    df = spark.createDataFrame([("f", text), ("g", None), ("h", "### first\na\n## top\nb")], "path string, text string")
    rows = importers.section_paths(df).withColumn("tags", importers.section_tags([("rules", "general", "-rules", ["rules"])])).orderBy("path", "pos").collect()
    got = [(r["title"], r["headers"], r["tags"], r["content"]) for r in rows]
    assert got[0] == ("first", ["first"], ["#general"], "a") or got[0][0] == "One"
    by = {r["title"]: r for r in rows}
    assert by["Sub [tea]"]["headers"] == ["One", "Sub [tea]"] and by["Sub [tea]"]["tags"] == ["#tea"] and by["Sub [tea]"]["content"] == "x\n```\n## not a header\n### nor this\n```\ny"
    assert by["Sub two"]["headers"] == ["One", "Sub two"] and by["Deep"]["tags"] == ["#general-rules", "#rules"] and by["Deep"]["content"] == "q\n#### low\nr"
    assert "Empty" not in by and by["Last"]["headers"] == ["Last"] and by["top"]["headers"] == ["top"] and by["first"]["headers"] == ["first"] and len(rows) == 7


def test_the_gate_keeps_the_callers_columns(spark):
    df = spark.createDataFrame([("some text that is long enough to be looked at", "mine", 7)], "_t string, _w string, _r int")
    (r,) = quality.gate(df, "_t").collect()
    assert (r["_t"], r["_w"], r["_r"]) == ("some text that is long enough to be looked at", "mine", 7) and r["quality_status"] == "ACCEPT"


def test_the_ledger_triggers_the_librarian_once(spark, tmp_path, monkeypatch):
    s, ran = Store(spark, str(tmp_path / "store")), []
    monkeypatch.setattr(Store, "run_librarian", lambda self, extra=None, **_: ran.append(1) or (self._save(extra=extra) or True) if len(ran) < 2 else False)
    s.log_event("one")
    s.log_event("two", type="consolidation_request")
    ledger.trigger_librarian(s, f"{tmp_path}/ck").awaitTermination()
    assert len(ran) == 1 and s.triggered(f"{tmp_path}/ck", 0, 5) is False and len(ran) == 1  # the batch again: no second run
    s.log_event("three")
    ledger.trigger_librarian(s, f"{tmp_path}/ck").awaitTermination()
    assert len(ran) == 2 and s.triggered("other", 0, 4) is False and snapshot.state(spark, s.root)[1]["triggers"]["other"] == {"batch": 0, "events": 4}


@pytest.mark.parametrize("name", ["TESSERA_ROOT"])
def test_root_by_the_environment(spark, tmp_path, monkeypatch, name):
    monkeypatch.setenv(name, str(tmp_path))
    assert Store(spark).root == str(tmp_path)
    monkeypatch.delenv(name)
    assert Store(spark).root.endswith("/tessera")


def test_an_index_gathers_places_before_rows_move(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a b a"), ("2", "b"), ("1", "a"), (None, "c")], "id string, text string")
    kept = index.TextIndex(spark, str(tmp_path / "index"), index.PLAIN)
    kept.update(docs, {"content": F.col("text")})
    found = {(r["id"], r["term"]): r["positions"] for r in kept.postings().collect()}
    assert found == {("1", "a"): [0, 0, 2], ("1", "b"): [1], ("2", "b"): [0]}  # rows of one id count as one
    kept.update(spark.createDataFrame([("2", "c b c")], "id string, text string"), {"content": F.col("text")})
    kept.compact()
    found = {(r["id"], r["term"]): r["positions"] for r in kept.postings().collect()}
    assert found == {("1", "a"): [0, 0, 2], ("1", "b"): [1], ("2", "b"): [1], ("2", "c"): [0, 2]}
    made = spark.createDataFrame([(["x", "y", "x"],)], "t array<string>").select(index.places("t").alias("p")).first()["p"]
    assert [(p["term"], p["positions"]) for p in made] == [("x", [0, 2]), ("y", [1])]


def test_an_index_keeps_a_line_for_each_term_of_a_chunk(spark, tmp_path, monkeypatch):
    """Postings of a chunk's rows lie together, none of a row that went is kept by a compaction, and what is live is told without their shuffle; chunks end anywhere."""
    docs = spark.range(300).coalesce(1).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Common words w"), F.col("id") % 7).alias("text"))
    kept = index.TextIndex(spark, str(tmp_path / "index"), index.PLAIN)
    kept.update(docs.repartition(1), {"content": F.col("text")})
    lines = lambda: kept._postings(kept.state()["segments"]).where("term = 'common'")
    assert lines().count() <= spark.sparkContext.defaultParallelism * 2 < 300
    kept.update(docs.where("id % 3 = 0").select("id", F.lit("other words").alias("text")), {"content": F.col("text")}, gone=docs.where("id % 3 = 1").select("id"))
    kept.compact()
    assert lines().select(F.explode("posts")).count() == 100
    want = {(str(i), "content", t, (p,), 2 if i % 3 == 0 else 3) for i in range(300) if i % 3 != 1 for p, t in enumerate(["other", "words"] if i % 3 == 0 else ["common", "words", f"w{i % 7}"])}
    assert set(held(kept)) == want and kept.state()["rows"] == 200 and kept.state()["len"] == 500
    found = kept.postings()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((g#" in found and "Join Inner, (id#" not in found


@pytest.mark.parametrize("rows", [1, 64, 200])
def test_chunks_of_any_size_hold_the_same_postings(monkeypatch, rows):
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(index, "TaskContext", Context)
    monkeypatch.setattr(index, "CHUNK_TOKENS", 50 if rows < 200 else 1 << 22)
    texts = [(f"{i // 3 if 90 < i < 300 else i:04}" if i else None, " ".join(f"w{j % (i % 5 + 1)}" for j in range(i % 9))) for i in range(400)]
    texts.sort(key=lambda x: (x[0] is not None, x[0]))
    table = pa.table({"id": [x[0] for x in texts], "f0": [x[1] for x in texts]}, pa.schema([("id", pa.string()), ("f0", pa.string())]))
    made = pa.Table.from_batches(index.packed(["content"], str.split)(table.to_batches(max_chunksize=rows))).to_pylist()
    ids = {r["c"]: r["ids"] for r in made if r["term"] is None}
    got = sorted((ids[r["c"]][p["at"]] or "", r["term"], p["positions"]) for r in made if r["term"] is not None for p in r["posts"])
    want = {}
    for i, t in texts:
        for at, w in enumerate(t.split()):
            want.setdefault((i or "", w), []).append(at)
    assert got == sorted((i, w, sorted(p)) for (i, w), p in want.items())
    assert (len(ids) == 1) == (rows == 200) and sum(map(len, ids.values())) == len({i for i, _ in texts})
    lens = {i: n for r in made if r["term"] is None for i, n in zip(r["ids"], r["lens"], strict=True)}
    assert lens.pop(None) == 0 and sum(lens.values()) == sum(len(t.split()) for i, t in texts if i is not None)


def test_sets_that_few_share_a_token_with_are_met_without_a_count_for_each():
    """Questions to a block of 200,000 classes with rare tokens take memory for what is met."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.operators import similar_sets

    def rows(asks, first, n, changed):
        tokens = (np.arange(n * 10).reshape(n, 10) * 7 + similar_sets.FREQUENT).astype(np.uint32)[:, ::-1].copy()
        tokens[:, 0] += changed
        rare = pa.array([t.tobytes() for t in tokens], pa.binary())
        cols = [np.zeros(n, np.int64), np.full(n, asks, np.int32), np.arange(first, first + n), np.full(n, 10, np.int32), np.ones(n, np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), rare, pa.array([b""] * n, pa.binary())], names=["cell", "asks", "cls", "n", "kind", "rare", "often"])

    def batches():
        asking = rows(1, 10**6, 64, 1)  # nine of ten tokens are shared
        yield rows(0, 0, 200_000, 0)
        yield asking.slice(0, 1)  # for which the block is made
        tracemalloc.start()
        yield asking.slice(1)

    found = pa.Table.from_batches(similar_sets._met(batches(), 0.8)).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["x"] - 10**6, r["y"]) for r in found] == [(i, i) for i in range(64)] and {round(r["similarity"], 9) for r in found} == {round(9 / 11, 9)}
    assert peak < 20e6  # a count for each of 32 x 200,000 pairs takes 51 MB


def test_strips_of_either_kind_return_the_same_pairs(monkeypatch):
    import random

    import numpy as np

    from tessera.operators import similar_sets

    rng = random.Random(5)

    def table(first, n):
        rows = [sorted(rng.sample(range(60), rng.randint(3, 12)), reverse=True) for _ in range(n)]
        rows.sort(key=len)
        size = np.array([len(r) for r in rows])
        return np.arange(first, first + n), size, np.ones(n, np.int64), np.concatenate(rows).astype(np.uint32), np.r_[0, size.cumsum()]

    held, asks = table(0, 300), table(1000, 100)

    def found(sparse):
        monkeypatch.setattr(similar_sets, "SPARSE", sparse)
        parts = list(similar_sets.Held([held], 0.5).ask(*asks, True))
        rows = [x for p in parts for x in zip(*(c.tolist() for c in p), strict=True)]
        assert len(rows) == len(set(rows))
        return len(parts), set(rows)

    (few, some), (many, all_) = found(1e-9), found(1e9)
    assert few == 1 and many == 4 and some == all_
    words = [[set(t[3][s:e].tolist()) for s, e in zip(t[4][:-1], t[4][1:], strict=True)] for t in (asks, held)]
    want = {(x, y, len(p & q)) for x, p in enumerate(words[0]) for y, q in enumerate(words[1]) if len(p) >= len(q) and len(p & q) / len(p | q) >= 0.5}
    assert some == want and want


def test_a_strip_that_meets_many_postings_compares_no_whole_sets(monkeypatch):
    """Of sets that share their frequent tokens only the others are counted; bits tell the rest. Copies, short sets and unknown tokens are among them."""
    import random

    import numpy as np

    from tessera.operators import similar_sets

    rng = random.Random(6)
    rows = [sorted({*rng.sample(range(300), rng.randint(4, 40)), *rng.sample(range(70_000, 1 << 22), rng.randint(0, 25))}, reverse=True) for _ in range(400)]
    rows += [r for r in rows[:30]] + [sorted({*r[:-3], rng.randint(1 << 22, 1 << 23)}, reverse=True) for r in rows[30:60]]
    rows.sort(key=len)
    size = np.array([len(r) for r in rows])
    cls = np.arange(len(rows))
    table = cls, size, np.full(len(rows), 3), np.concatenate(rows).astype(np.uint32), np.r_[0, size.cumsum()]
    looked, runs = [0], similar_sets._runs

    def counted(starts, lengths):
        looked[0] += int(lengths.sum())
        return runs(starts, lengths)

    monkeypatch.setattr(similar_sets, "SPARSE", 1e9)
    block = similar_sets.Held([table], 0.25)
    monkeypatch.setattr(similar_sets, "_runs", counted)
    found = {x for p in block.ask(*table, True) for x in zip(*(c.tolist() for c in p), strict=True)}
    sets = [set(r) for r in rows]
    assert found == {(a, b, len(sets[a] & sets[b])) for a in cls for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.25} and found
    assert not any(len(p[0]) for p in block.ask(*table, False))
    assert looked[0] == 0  # neither postings of prefixes nor whole sets of candidates


def test_texts_are_cut_into_tokens_once(spark):
    from tessera.operators import similar_sets

    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(text):
        cut.add(1)
        return sorted(set(text.split()))

    df = spark.createDataFrame([(i, f"one two three w{i // 2}") for i in range(20)], "id long, text string").repartition(2).select("id", tokens("text").alias("tokens"))
    got = {(r["a"], r["b"]) for r in similar_sets.similar_pairs(df, df, 0.9).collect() if r["a"] < r["b"]}
    assert got == {(i, i + 1) for i in range(0, 20, 2)}
    assert cut.value == 20


def test_word_sets_are_those_of_the_plain_pattern(spark):
    texts = [None, "", "a bc", "abc ABC abc_1 é\u0301té naïve", "İstanbul ΣΑΣ straße ½½½ ①②③ 中文字 x\u00adyz ab\u200bcd \U0001d400\U0001d401\U0001d402 ٣٤٥"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1))))
    rows = df.select(X.word_set(F.lower("t")).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and rows[-1]["got"]


def test_a_text_of_many_requests_is_in_no_single_window(spark, monkeypatch):
    """Of requests with one text the first counts, by owner; no window holds those of a text."""
    from tessera.plans import store as storing
    from tessera.schema import empty

    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(storing, "checkpointed", cut)
    text = "The valve of the northern pump was changed after the second test and the report names each part"
    asked = [(i, f"o{i % 2}" if i < 8 else None, f"title {i}", text) for i in range(10)] + [(20, "o0", "blank", " "), (21, "o0", "blank too", " ")]
    requests = spark.createDataFrame(asked, "seq long, owner_id string, title string, full_content string")
    _, _, result = storing.store(empty(spark, "entities"), empty(spark, "relations"), requests, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    got = {r["seq"]: r["result"] for r in result.collect()}
    assert got == {0: "stored", 1: "stored"} | {i: "exact duplicate" for i in range(2, 8)} | {i: "owner_id is missing" for i in (8, 9)} | {20: "content is blank", 21: "content is blank"}
    windows = [line for p in plans for line in p.splitlines() if "Window [" in line]
    assert windows and not any("content_hash" in line.rpartition("], [")[0].rpartition("[")[2] or "owner_id" in line for line in windows)
