"""Centroid clustering, fill-in-middle and scaled sketches against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, hamerly, registry, scaled_sketch

WORDS = "the river ran past old stone houses while people walked slowly home under grey evening clouds and talked about rain".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 11 --------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, scale=1024, seed=3):
    """(id, vector) -> sorted (id, cluster, distance), centroids."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        at = [min(range(len(cents)), key=lambda c: (dist(v, cents[c]), c)) for _, v in kept]
        if i < rounds:
            for c in range(len(cents)):
                own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
                if own:
                    cents[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i if i is not None else -1), a, dist(v, cents[a])) for (i, v), a in zip(kept, at, strict=True)), cents


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    return [(i, (centres[i % 5] * spread + rng.normal(size=size) * 0.4).astype(np.float32).tolist()) for i in range(n)]


def test_clusters(spark):
    size = 4
    rows = vectors(300, size, 1) + [(7, [0.5] * size)] * 40 + [(None, [0.1, -0.2, 0.3, 0.0])] * 2 + [(900 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(10)]
    odd = [(1000, None), (1001, [1.0] * 3), (1002, [1.0, None, 1.0, 1.0]), (1003, [1.0, math.nan, 1.0, 1.0]), (1004, [1.0, math.inf, 1.0, 1.0]), (1005, [])]
    df = spark.createDataFrame([(i, v, "kept", 5) for i, v in rows + odd], "vec_id long, embedding array<float>, rid string, cluster int")
    scanned = []
    out = hamerly.cluster(df, clusters=6, rounds=5, size=size, seen=lambda state, i: scanned.append(state.where("cluster <> was").count()))
    got = out.collect()
    want, cents = brute_clusters(rows, 6, 5)
    assert sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["cluster"], r["distance"]) for r in got) == want
    assert {r["centroid_sha256"] for r in got} <= {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents}
    assert all(r["rid"] == "kept" and r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in got)
    assert len(scanned) == 5 and out.columns == ["vec_id", "embedding", "rid", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_few_and_of_large_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    big = [(1, [3e5, 1.0]), (2, [3e5, 1.5]), (3, [-2e5, 0.0]), (4, [0.0, 0.0])]
    got = hamerly.cluster(spark.createDataFrame(big, schema), clusters=3, rounds=3, size=2).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == brute_clusters(big, 3, 3)[0]
    two = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    got = hamerly.cluster(spark.createDataFrame(two, schema), clusters=8, rounds=2, size=2).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0), (0, 0)]
    none = hamerly.cluster(spark.createDataFrame([(1, None)], schema), size=2)
    assert none.collect() == [] and none.columns[:2] == ["vec_id", "embedding"]
    huge = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])]
    got = {r["vec_id"]: r["distance"] for r in hamerly.cluster(spark.createDataFrame(huge, schema), clusters=1, rounds=1, size=2).collect()}
    assert got[1] == hamerly.LARGEST


def test_bounds_hold_and_rounds_do_not_shuffle_vectors(spark, monkeypatch):
    """Every bound is on its side of the exact distances, most rows are settled without a scan, and a round's plan has no exchange."""
    size, rows = 8, vectors(4000, 8, 3, 6.0)
    exact = {i: np.array([math.floor(1024 * float(x)) for x in v], dtype=object) for i, v in rows}
    plans, share = [], []
    plain = hamerly._next

    def spied(state, stored, old, new):
        loose = hamerly.bounds_after(state, old, new)
        share.append(loose.where("ambiguous").count())
        ids = {r["rid"]: tuple(r["x"]) for r in stored.collect()}
        for r in loose.collect():
            d = [math.sqrt(sum((a - b) ** 2 for a, b in zip(ids[r["rid"]], c, strict=True))) for c in new]
            assert d[r["cluster"]] <= r["upper"] and all(x >= r["lower"] for j, x in enumerate(d) if j != r["cluster"])
            if not r["ambiguous"]:
                assert all(d[r["cluster"]] < x for j, x in enumerate(d) if j != r["cluster"])
        out = plain(state, stored, old, new)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(hamerly, "_next", spied)
    out = hamerly.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), clusters=5, rounds=4, size=size)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()) == brute_clusters(rows, 5, 4)[0]
    assert len(exact) == 4000 and share[-1] < 2000
    assert all("Exchange" not in p and "SortMergeJoin" in p for p in plans)


# 12 --------------------------------------------------------------------------------------------------------------

FIM_TEXTS = [None, "", "\n", "\n\n", "one", "one\n", "a\nb\nc", "a\r\nb\n\n\nc\n", "x <S y\n<S\n>", "has <P> mark", "tail <M>", prose(1, 5000).replace(" ", "\n"), "é日本\n語 x\n", "y" * 10000, "<\n<S\n>S>\n"]
FIM_IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None, 14, 14]


def brute_fim(row_id, text, unit, percent, spm):
    text = text or ""
    h = hashlib.sha256(f"7:{'null' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(unit, text)
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= percent:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "percent", "spm"), [(fill_middle.LINES, 100, 50), (r"(?s).", 100, 0), (fill_middle.LINES, 50, 100)])
def test_fill_in_middle(spark, unit, percent, spm):
    df = spark.createDataFrame([(i, t, "own") for i, t in zip(FIM_IDS, FIM_TEXTS, strict=True)], "doc_id long, text string, form string")
    out = fill_middle.fill_in_middle(df, unit=unit, percent=percent, spm_percent=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((i, *brute_fim(i, t, unit, percent, spm)) for i, t in zip(FIM_IDS, FIM_TEXTS, strict=True)), key=str)
    assert out.where("back <> coalesce(text, '')").count() == 0 and out.where("form <> 'plain'").count() > 4
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


def test_forms_follow_their_shares():
    unit = re.compile(fill_middle.LINES)
    forms = [fill_middle.transformed(unit, "a\nb\nc\n", i, percent=60, spm_percent=25)[1] for i in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.4) < 0.03 and abs(forms.count("spm") / 4000 - 0.15) < 0.03


def test_units_are_not_stored():
    """The matcher's memory doesn't grow with the number of units."""
    import tracemalloc

    unit, text = re.compile(fill_middle.LINES), "a\n" * 400_000
    tracemalloc.start()
    sum(1 for _ in fill_middle.unit_ends(unit, text))
    a, b = fill_middle.cuts(unit, text, (100_000, 300_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (a, b) == (200_000, 600_000) and peak < 100_000


# 13 --------------------------------------------------------------------------------------------------------------


def brute_sketch(text, fraction=scaled_sketch.FRACTION, words=5):
    h = [int(x) for part in scaled_sketch.shingle_hashes(text or "", words) for x in part]
    low = sorted({x for x in h if x < scaled_sketch.threshold(fraction)})
    return low or sorted(h)[:1]


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        out.append((doc_id, edited, brute_sketch(text), brute_sketch(edited), brute_sketch(following)))
    return out


def test_shingle_hashes_tell_shingles_apart():
    texts = [prose(i, 40) for i in range(200)]
    seen = {}
    for t in texts:
        w = t.split()
        for i, h in enumerate(int(x) for part in scaled_sketch.shingle_hashes(t) for x in part):
            assert seen.setdefault(h, tuple(w[i : i + 5])) == tuple(w[i : i + 5])
    assert len(seen) == len(set(seen.values()))
    once = np.concatenate(list(scaled_sketch.shingle_hashes(prose(9, 3000))))
    assert len(list(scaled_sketch.shingle_hashes("a b"))[0]) == 1 and list(scaled_sketch.shingle_hashes(" \n")) == []
    assert np.array_equal(np.concatenate(list(scaled_sketch.shingle_hashes("A b C d E f"))), np.concatenate(list(scaled_sketch.shingle_hashes("a\tb c\nd e  f"))))
    assert abs((np.unique(once) < scaled_sketch.threshold(0.25)).mean() - 0.25) < 0.04


def test_blocks_of_shingles(monkeypatch):
    text = prose(4, 700)
    whole = scaled_sketch.sketch(text)
    monkeypatch.setattr(scaled_sketch, "BLOCK", 64)
    assert np.array_equal(scaled_sketch.sketch(text), whole)


@pytest.mark.parametrize("range_rows", [1 << 13, 3])
def test_next_rows(spark, monkeypatch, range_rows):
    monkeypatch.setattr(scaled_sketch, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(scaled_sketch, "PER_RANGE", 1 if range_rows == 3 else 16)
    monkeypatch.setattr(scaled_sketch, "TASK_ROWS", 20)
    rows = [(i * 7 - 50, prose(i, 10 + i)) for i in range(60)] + [(None, "no id"), (None, None), (13, "tie b"), (13, "tie a"), (13, "tie a"), (-50, "first id again"), (1000, ""), (1001, "one"), (1002, prose(8, 20_000)), (1003, None), (-8, "x"), (-8, "w")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, is_tail string")
    if range_rows == 3:
        assert len(scaled_sketch.range_starts(df, "doc_id", len(rows))) > 8
    got = [(r["doc_id"], r["edited"], r["sketch"], r["edited_sketch"], r["next_sketch"]) for r in scaled_sketch.with_next(df).collect()]
    assert sorted(got, key=str) == sorted(brute_next(rows), key=str)


def test_next_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    (r,) = scaled_sketch.with_next(df).collect()
    assert r["edited"] == "a b c d a b c d"[:8] + "a b c d"[:7] and r["sketch"] == r["next_sketch"]
    assert scaled_sketch.with_next(df.limit(0)).collect() == []


def test_likeness_and_containment(spark):
    long_, part = prose(1, 12_000), None
    part = " ".join(long_.split()[3000:3600])
    rows = [("same", long_, long_), ("part", part, long_), ("other", prose(2, 600), prose(3, 800)), ("none", "", None), ("half", "", "a b")]
    df = spark.createDataFrame(rows, "name string, a string, b string")
    df = scaled_sketch.with_sketch(scaled_sketch.with_sketch(df, "a", "x"), "b", "y")
    got = {r["name"]: r for r in df.select("name", scaled_sketch.containment(F.col("x"), F.col("y")).alias("c"), scaled_sketch.containment(F.col("y"), F.col("x")).alias("d"), scaled_sketch.likeness(F.col("x"), F.col("y")).alias("l")).collect()}
    assert got["same"]["l"] == 1 and got["part"]["c"] == 1 == got["part"]["l"] and 0.02 < got["part"]["d"] < 0.09
    assert got["other"]["l"] < 0.05 and got["none"]["l"] == 1 and got["half"]["l"] == 0


def test_merged_sketches(spark):
    texts = [("a", prose(1, 300)), ("a", prose(2, 200)), ("b", "one two"), ("b", "three"), ("c", "four five"), ("c", prose(3, 100)), ("d", ""), (None, "x y z")]
    df = scaled_sketch.with_sketch(spark.createDataFrame(texts, "g string, text string"))
    got = {r["g"]: r["sketch"] for r in scaled_sketch.merged(df, ["g"]).collect()}
    limit = scaled_sketch.threshold()
    for g in ("a", "b", "c", "d", None):
        every = {h for k, t in texts if k == g for h in brute_sketch(t)}
        assert got[g] == (sorted(h for h in every if h < limit) or sorted(every)[:1])


def test_queries_are_whole(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op11_hamerly_clusters", "op12_fill_middle", "op13_scaled_sketches"):
        source = "embeddings" if "11" in name else "documents"
        assert registry.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
