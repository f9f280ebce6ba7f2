"""Near-duplicates by the Jaccard similarity of word shingles: SimHash balls and MinHash bands propose pairs, the texts decide.

Texts whose SimHash fingerprints over the same shingles are equal or linked (simhash.py: three bits at most) are compared first. That
finds copies and the nearest ones; most pairs near the limit are more bits apart, for which there are the bands.

The signature of a text is cut into BANDS bands of ROWS minima. Texts that agree in a band share a bucket; two texts
of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS, which is 0.9999 at 0.8 and more above. Each
proposed pair is compared by its whole shingle sets, so no link is below the limit. First every text is compared
with its bucket's hub, the least one, which joins a large group of copies with as many comparisons as members. Then,
in buckets whose texts aren't one component yet, what those texts can share at all is counted: two texts of similarity s
share s / (1 + s) of their sizes' sum or more, and neither shares a shingle that no other of these texts has. Texts that
can't reach the limit with anyone drop out; the others are compared with the bucket's text of fewest shingles of its own,
which joins those near a common original, and then across the components that remain, where sizes, counts and the counts
by CELLS cells of the shingles' hashes allow it: two texts share no more than the sum over cells of the lesser count.

Defined cases: texts without words, and null ones, are near copies of each other only; texts of fewer words than a
shingle are one shingle; texts of equal 64-bit hashes are one text; rows without an id stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tessera.llm.common import SLICE_ROWS, fresh, map_rows, materialize
from tessera.llm.components import components
from tessera.llm.simhash import fingerprint, links, rows_of_ids

WORDS, LIMIT = 5, 0.8
BANDS, ROWS = 32, 6
SEED = 42
#: Cells that a text's shareable shingles are counted in.
CELLS = 64
#: Shingles whose minima are taken at a time.
BLOCK = 1 << 10

FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, in ascending order."""
    found = (text or "").lower().encode("utf-8", "surrogatepass").split()
    n = min(len(found), max(1, len(found) - words + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[i : i + words]), SEED) for i in range(n)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def bands(hashes: np.ndarray) -> list[int]:
    """The buckets of a shingle set, as signed 64-bit integers."""
    if not len(hashes):
        return [0]
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + BLOCK]).min(axis=1), out=least)
    made = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(made, np.uint64).view(np.int64).tolist()


def verified(pairs: DataFrame, texts: DataFrame, words: int, limit: float) -> DataFrame:
    """Those of pairs (a, b, and the components x, y that they are in so far) whose texts (t, text) reach the limit."""
    left, right = (texts.select(F.col("t").alias(f"t_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = pairs.join(left, F.col("a") == F.col("t_a")).join(right, F.col("b") == F.col("t_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def of(text: str) -> np.ndarray:
            return shingles(text, words)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                near = [jaccard(of(s), of(t)) >= limit for s, t in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                yield part.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    return joined.select("a", "b", "x", "y", "text_a", "text_b").mapInArrow(run, "a long, b long, x long, y long")


def shareable(of: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """of, can and cells: how many shingles of each text (t) at least one other of them has as well, in all and by cell."""
    some = texts.join(of.withColumnRenamed("t", "own"), F.col("t") == F.col("own"), "left_semi")
    schema = [("shingles", ArrayType(LongType()))]
    each = map_rows(some.select("t", "text"), ["text"], schema, lambda: lambda rows: [(shingles(t, words).view(np.int64).tolist(),) for (t,) in rows])
    each = each.select("t", F.explode("shingles").alias("s"))
    # A shingle of no other text tells of itself; those of several are of no further interest.
    alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("t").alias("t")).where("c = 1")
    cell = F.pmod("s", F.lit(CELLS)).cast("int").alias("cell")
    counted = each.select("t", cell, F.lit(1).alias("k")).unionByName(alone.select("t", cell, F.lit(-1).alias("k"))).groupBy("t", "cell").agg(F.sum("k").alias("k"))
    held = counted.groupBy("t").agg(F.sum("k").alias("can"), F.map_from_entries(F.collect_list(F.struct("cell", F.col("k").cast("int")))).alias("m"))
    by_cell = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
    return held.select(F.col("t").alias("of"), "can", by_cell.alias("cells"))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b, n, n2) of texts to compare with their shingles: each with the least of its fingerprint, and the least ones of linked fingerprints. nodes: t, n, fp."""
    least = materialize(nodes.groupBy(F.col("fp").alias("of")).agg(F.min(F.struct("t", "n")).alias("hub")), "minhash-fingerprints")
    same = nodes.join(least, F.col("fp") == F.col("of")).where(F.col("t") != F.col("hub.t")).select(F.col("t").alias("a"), F.col("hub.t").alias("b"), "n", F.col("hub.n").alias("n2"))
    ends = [least.select(F.col("of").alias(f"fp_{x}"), F.col("hub").alias(f"hub_{x}")) for x in "ab"]
    near = links(least.select(F.col("of").alias("fp"))).join(ends[0], F.col("a") == F.col("fp_a")).join(ends[1], F.col("b") == F.col("fp_b"))
    near = near.select(F.col("hub_a.t").alias("a"), F.col("hub_b.t").alias("b"), F.col("hub_a.n").alias("n"), F.col("hub_b.n").alias("n2"))
    return materialize(same.unionByName(near), "minhash-linked")


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """The rows (b, t, n, can, root) of buckets b that hold several components (root), and top, the one of most rows there."""
    sizes = rows.groupBy("b", "root").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("b").alias("of")).agg(F.max(F.struct("c", "root")).alias("largest"), F.count(F.lit(1)).alias("roots"))
    found = rows.join(sizes.where("roots > 1").select("of", F.col("largest.root").alias("top")), F.col("b") == F.col("of"))
    return found.select("b", "t", "n", "can", "root", "top")


def component_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """t (the text's hash), first (its least id) and component_id (its component's least id) of every distinct text."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))

    def make():
        def one(text: str) -> tuple:
            found = shingles(text, words)
            return len(found), bands(found), fingerprint(text, words)

        return lambda some: [one(t) for (t,) in some]

    banded = map_rows(rows, ["text"], [("n", LongType()), ("bands", ArrayType(LongType())), ("fp", LongType())], make).drop("text")
    nodes = materialize(banded.groupBy("t").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "minhash-texts")
    linked = by_fingerprint(nodes)
    buckets = nodes.select(F.explode("bands").alias("b"), "t", "n")
    hubs = buckets.groupBy(F.col("b").alias("of")).agg(F.min(F.struct("t", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("of", F.col("hub.t").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = materialize(buckets.join(hubs, F.col("b") == F.col("of")).select("b", "t", "n", "hub", "hub_n"), "minhash-buckets")
    needed = shared.select(F.col("t").alias("of")).unionByName(linked.select(F.explode(F.array("a", "b")).alias("of"))).distinct()
    texts = materialize(rows.join(needed, F.col("t") == F.col("of"), "left_semi").groupBy("t").agg(F.first("text").alias("text")), "minhash-candidates")

    def fits(a: str, b: str):
        return F.least(a, b) >= F.greatest(a, b) * limit

    to_hub = shared.where((F.col("t") != F.col("hub")) & fits("n", "hub_n")).select(F.col("t").alias("a"), F.col("hub").alias("b"))
    to_hub = to_hub.unionByName(linked.where(fits("n", "n2")).select("a", "b")).distinct()
    roots = components(verified(to_hub.withColumns({"x": F.col("a"), "y": F.col("b")}), texts, words, limit), "a", "b")
    rooted = materialize(shared.join(roots, F.col("t") == F.col("node"), "left").select("b", "t", "n", "hub", F.coalesce("root", "t").alias("root")), "minhash-roots")
    mixed = rooted.groupBy(F.col("b").alias("of")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("of")
    # The hub has been compared with all.
    rest = materialize(rooted.where("t != hub").join(mixed, F.col("b") == F.col("of"), "left_semi").select("b", "t", "n", "root"), "minhash-mixed")
    usable = materialize(shareable(rest.select("t").distinct(), texts, words), "minhash-shareable")
    rest = rest.join(usable, F.col("t") == F.col("of")).where(F.col("can") >= F.col("n") * limit).select("b", "t", "n", "can", "root")
    rest = materialize(rest, "minhash-open")
    best = rest.groupBy(F.col("b").alias("of")).agg(F.max(F.struct((F.col("can") / F.col("n")).alias("share"), "t", "n", "root", "can")).alias("best"))
    second = materialize(rest.join(best, F.col("b") == F.col("of")).select("b", "t", "n", "can", "root", F.col("best.t").alias("t2"), F.col("best.n").alias("n2"), F.col("best.can").alias("can2"), F.col("best.root").alias("root2")), "minhash-second")

    def least_shared() -> Column:
        return (F.col("n") + F.col("n2")) * (limit / (1 + limit)) - 1e-6

    def may_link() -> Column:
        return (F.col("root") != F.col("root2")) & fits("n", "n2") & (F.col("can") >= least_shared()) & (F.col("can2") >= least_shared())

    def as_pairs(df: DataFrame) -> DataFrame:
        ends = F.struct(F.col("t"), F.col("root")), F.struct(F.col("t2").alias("t"), F.col("root2").alias("root"))
        ends = df.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
        return ends.select(F.col("a.t").alias("a"), F.col("b.t").alias("b"), F.col("a.root").alias("x"), F.col("b.root").alias("y")).distinct()

    def renamed(df: DataFrame, by: DataFrame) -> DataFrame:
        """df with the roots that its components have become one under."""
        by = by.select(F.col("node").alias("from_root"), F.col("root").alias("to_root"))
        return df.join(by, F.col("root") == F.col("from_root"), "left").withColumn("root", F.coalesce("to_root", "root")).drop("from_root", "to_root")

    # From here on whole components are linked, by their roots.
    merged = components(verified(as_pairs(second.where(may_link())), texts, words, limit), "x", "y")
    rest = renamed(second.where("t != t2").drop("root2", "t2", "n2", "can2"), merged)
    rest = materialize(rest, "minhash-last")
    rest = materialize(mixed_buckets(rest).join(usable.select("of", "cells"), F.col("t") == F.col("of")).drop("of"), "minhash-across")
    # Two texts of a bucket's largest component need no comparison, so one of each pair is of another.
    few, other = rest.where("root != top").drop("top"), rest.select(*[F.col(c).alias(f"{c}2") for c in ("b", "t", "n", "can", "root", "cells")])
    most = F.aggregate(F.zip_with("cells", "cells2", lambda x, y: F.least(x, y)), F.lit(0), lambda sum, x: sum + x)
    across = few.join(other, (F.col("b") == F.col("b2")) & may_link() & (most >= least_shared()))
    across = materialize(as_pairs(across), "minhash-across-pairs")
    last = components(verified(across, texts, words, limit), "x", "y")
    whole = nodes.join(roots, F.col("t") == F.col("node"), "left").select("t", "first", F.coalesce("root", "t").alias("root"))
    whole = materialize(renamed(renamed(whole, merged), last), "minhash-components")
    least = whole.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    return whole.join(least, F.col("root") == F.col("of")).select("t", "first", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """df with one row of each component: the one of the least id; of rows that share this id, one. Rows without an id stay."""
    found = component_ids(df, id_col, text_col, words, limit)
    (kept,) = fresh(df, "kept_id")
    return rows_of_ids(df, found.where("first = component_id").select(F.col("component_id").alias(kept)).distinct(), id_col, kept)
