"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits have a common variant: a word that is near both. With
three differing bits two of them lie in the same half of the word, and one of the fingerprints has an even number
of set bits, the other an odd one. So it is enough that every fingerprint emits itself, its 64 variants at one bit
and its 496 variants at two bits of one half: of the low half if it is even, of the high half if it is odd. All
fingerprints that emit a variant meet there; those at most one bit away from it are within two bits of each other
and at most three from the rest. The least of them is the variant's hub, and a link from each member to the hub
(verified by counting bits) keeps every component together with no more links than members.

What is shuffled isn't each variant but a row for each half that a fingerprint's variants share: those at bits of
one half agree in the other half, whose 32 bits are the shuffle key. Fingerprints that are alone under their key
meet nobody and are dropped before their variants are made. Where more than EXPANDED rows share a key (texts of one
template may), they pass on as they are, and their variants themselves are shuffled: as a variant is met by no more
fingerprints than a ball holds, no task then has a large group whatever the number of fingerprints.

Defined cases: a text without words, and a null one, has fingerprint zero, linked like any other; texts of fewer
words than a shingle are one shingle; rows with a null id take part, and a component's id is its least id that
isn't null; repeated rows come out as often; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import fresh, map_rows, materialize
from tessera.llm.components import components

SEED, RADIUS = 42, 3
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Rows of a key whose variants meet in one task; those of a larger one meet by a shuffle.
EXPANDED = 1 << 13

LOW, HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
BIT = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)
PAIRS = {half: np.array([BIT[i] ^ BIT[j] for i, j in combinations(range(32 * half, 32 * half + 32), 2)], np.uint64) for half in (0, 1)}


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over word shingles, repeats included, as a signed 64-bit integer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, ends = b" ".join(found), list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    ends = ends[words - 1 :] if len(found) >= words else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)], ends[at : at + BLOCK], strict=False)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    return map_rows(df, [text_col], [(out, LongType())], lambda: lambda rows: [(fingerprint(t, words),) for (t,) in rows])


def _emissions(fps: DataFrame) -> DataFrame:
    """(space, key, fp, flip): the halves that the variants of fp share.

    Space 0 is keyed by the high half and makes pairs of the low half meet, space 1 the other way round. flip is
    the bit of the key's half that differs from fp, or -1: then the variants differ from fp in the other half only.
    """
    out = None
    for space in (0, 1):
        bits = range(32, 64) if space == 0 else range(32)
        key = (lambda c: F.shiftright(c, 32)) if space == 0 else (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))
        # In space 1 single flips of the odd ones are needless: they are where the pairs come from, and closer ones meet in space 0.
        flips = fps if space == 0 else fps.where(F.bit_count("fp") % 2 == 0)
        own = fps.select(F.lit(space).alias("space"), key(F.col("fp")).alias("key"), "fp", F.lit(-1).alias("flip"))
        bit = F.explode(F.array(*[F.lit(i) for i in bits])).alias("flip")
        other = flips.select("fp", bit).select(F.lit(space).alias("space"), key(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, flip)"))).alias("key"), "fp", "flip")
        part = own.unionByName(other)
        out = part if out is None else out.unionByName(part)
    return out


def variants(space: int, fps: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, fingerprint, distance) of emission rows of one space."""
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    whole = flips < 0
    made = [(fps[~whole] ^ BIT[flips[~whole]], fps[~whole], np.ones(int((~whole).sum()), np.int8))]

    def ball(own: np.ndarray, masks: np.ndarray, distance: int) -> None:
        made.append(((own[:, None] ^ masks[None, :]).ravel(), np.repeat(own, len(masks)), np.full(len(own) * len(masks), distance, np.int8)))

    if space == 0:
        ball(fps[whole], np.zeros(1, np.uint64), 0)
        ball(fps[whole], BIT[:32], 1)
        ball(fps[whole & ~odd], PAIRS[0], 2)
    else:
        ball(fps[whole & ~odd], BIT[32:], 1)
        ball(fps[whole & odd], PAIRS[1], 2)
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def hub_links(space: int, fps: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Verified (fingerprint, hub) pairs among EXPANDED fingerprints at most under the same key, or many under small ones, distinct."""
    v, f, d = variants(space, fps, flips)
    order = np.lexsort((f, d > 1, v))
    v, f, d = v[order], f[order], d[order]
    first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
    at = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))  # where the run of the variant begins: its hub
    pairs = np.stack([f, f[at]], axis=1)[(d[at] <= 1) & (f != f[at])]
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]
    return np.unique(pairs, axis=0)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of linked fingerprints that hold every component together. fps: distinct fp (long)."""
    rows = _emissions(fps)
    rows = rows.repartition("space", "key").sortWithinPartitions("space", "key")

    def made(a: np.ndarray, b: np.ndarray, space: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(np.full(len(a), space, np.int32))], names=["a", "b", "space"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (space -1) within the keys of few rows; the rows (fp, flip, space) of the others."""
        held: list[np.ndarray] = []  # rows of the last key, whose run may go on
        large = (-1, 0)  # the last key of too many rows

        def met(space: np.ndarray, key: np.ndarray, fp: np.ndarray, flip: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links within whole runs of keys."""
            if not len(key):
                return
            new = np.r_[True, (key[1:] != key[:-1]) | (space[1:] != space[:-1])]
            run_id = np.cumsum(new) - 1
            size = np.bincount(run_id)[run_id]
            for s in (0, 1):
                many = (size > EXPANDED) & (space == s)
                if many.any():
                    yield made(fp[many], flip[many], s)
                few = np.flatnonzero((size > 1) & (size <= EXPANDED) & (space == s))
                at = 0
                while at < len(few):  # whole runs, EXPANDED rows or one run at a time
                    end = min(len(few), at + EXPANDED)
                    while end < len(few) and end > at and run_id[few[end]] == run_id[few[end - 1]]:
                        end -= 1
                    if end == at:
                        end = at + int(np.searchsorted(run_id[few[at:]], run_id[few[at]], "right"))
                    pairs = hub_links(s, fp[few[at:end]].view(np.uint64), flip[few[at:end]]).view(np.int64)
                    if len(pairs):
                        yield made(pairs[:, 0], pairs[:, 1], -1)
                    at = end

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            more = (cols[0] == large[0]) & (cols[1] == large[1])
            if more.any():
                yield made(cols[2][more], cols[3][more], large[0])
                cols = [c[~more] for c in cols]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            space, key = cols[0], cols[1]
            if not len(key):
                held = []
                continue
            last = (space == space[-1]) & (key == key[-1])
            cut = int(np.argmax(last))
            yield from met(*[c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
            if len(held[0]) > EXPANDED:
                large = (int(held[0][0]), int(held[1][0]))
                yield made(held[2], held[3], large[0])
                held = []
        if held:
            yield from met(*held)

    found = materialize(rows.select("space", "key", "fp", "flip").mapInArrow(run, "a long, b long, space int"), "met")
    near = found.where("space < 0").select("a", "b")
    many = found.where("space >= 0")
    if many.limit(1).count():
        near = near.unionByName(shuffled_links(many.select("space", F.col("a").alias("fp"), F.col("b").alias("flip"))))
    return near.distinct()


def shuffled_links(rows: DataFrame) -> DataFrame:
    """The links of hub_links for rows (space, fp, flip) of any number, by a shuffle on the variants. Some may be found twice."""

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space, fp, flip = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for s in (0, 1):
                mine = np.flatnonzero(space == s)
                for at in range(0, len(mine), 256):
                    some = mine[at : at + 256]
                    v, f, d = variants(s, fp[some].view(np.uint64), flip[some])
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(f.view(np.int64)), pa.array(d > 1)], names=["v", "f", "far"])

    spread = rows.repartition(F.col("fp"), F.col("flip"))  # a key's rows lie in one task, and each makes hundreds
    met = spread.mapInArrow(expand, "v long, f long, far boolean").repartition("v")
    met = met.withColumn("hub", F.min(F.struct("far", "f")).over(Window.partitionBy("v")))
    near = met.where(~F.col("hub.far") & (F.col("f") != F.col("hub.f"))).select(F.col("f").alias("a"), F.col("hub.f").alias("b")).distinct()
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row."""
    rows = materialize(with_fingerprint(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words).select("doc_id", "fingerprint"), "fingerprints")
    distinct = materialize(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of")
    named = materialize(rooted.join(least, F.col("root") == F.col("of")).select("fp", "component_id"), "components")
    return rows.join(named, F.col("fingerprint") == F.col("fp")).select("doc_id", "fingerprint", "component_id")


def rows_of_ids(df: DataFrame, keep: DataFrame, id_col: str, kept: str) -> DataFrame:
    """The rows of df whose id is in keep's column kept (distinct), one of those that share an id, and the rows without an id."""
    (nth,) = fresh(df, "nth")
    joined = df.join(keep, F.col(id_col) == F.col(kept))
    # The join has the rows of an id together and sorted already.
    first = joined.withColumn(nth, F.row_number().over(Window.partitionBy(id_col).orderBy(id_col))).where(F.col(nth) == 1).drop(kept, nth)
    return first.unionByName(df.where(F.col(id_col).isNull()))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """df with one row of each component: the one of the least id; of rows that share this id, one. Rows without an id stay."""
    found = near_duplicates(df, id_col, text_col, words)
    (kept,) = fresh(df, "kept_id")
    return rows_of_ids(df, found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(kept)).distinct(), id_col, kept)
