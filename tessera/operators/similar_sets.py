"""Pairs of similar token sets, exactly: sets meet in cells of a grid, where postings of their rarest tokens are counted.

Sets are written once as numbers, from the rarest token on: the FREQUENT most frequent tokens have their places as numbers (two
bytes), others 32 bits of their hash (tokens whose bits agree get numbers of their own, so no two tokens share one). Equal
sets are one class. A class of n tokens is held in a block of classes of about its size, and asks all blocks that can hold a partner that
isn't larger. Two sets that are similar enough share a token among the rarest of each, so a block has postings of these alone; what a set shares
with each of a block's is counted, and where that and what may follow reach the limit, the whole sets are compared. Where a set meets many of a block, all
of its tokens are counted but the most frequent ones; of these a pair shares no more than the lesser has, and bits tell how many.

A task holds one block, of BLOCK tokens at most or one set, and reads those that ask a strip at a time. What is shuffled grows with the
tokens times the blocks that they ask, and the counting with the pairs that share a rare token: with the square of the rows in the
worst case, but neither candidates nor whole sets are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: Tokens with numbers of two bytes; below RESERVED are these and those whose hashes' bits agree.
FREQUENT, RESERVED = 1 << 16, 1 << 21
TWO_BYTES = 1 << 16
#: Tokens of a block, at most and, of small tables, at least.
BLOCK, LEAST_BLOCK = 1 << 23, 1 << 16
#: Sets that ask at a time where few of a block are met, and where there is a count for each; postings or tokens that are looked at at a time.
WIDE, STRIP, AT_ONCE = 1024, 32, 1 << 21
#: Postings are sorted where they are so many times fewer than those counts.
SPARSE = 16
#: Tokens whose bits tell what two sets share, at most, and bits of a block.
COMMON, BITS = 2048, 1 << 29
LOW = 0xFFFFFFFF


def vocabulary(tokens: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, hashes in ascending order, numbers) of the tokens that have a number of their own. tokens: token, repeats included."""
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    for seed in range(8):
        found = written(df.select(F.xxhash64(F.lit(seed), "token").alias("h"), "df"), "tokens")
        low = F.col("h").bitwiseAND(F.lit(LOW))
        alike = found.groupBy(low.alias("low")).agg(F.collect_set("h").alias("hs"), F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) | (F.col("low") < RESERVED)).select("hs", "c").collect()
        if any(len(r["hs"]) < r["c"] for r in alike):
            continue  # two tokens of one hash
        often = [r["h"] for r in found.orderBy(F.desc("df"), "h").limit(FREQUENT).select("h").collect()]
        others = sorted({h for r in alike for h in r["hs"]} - set(often))
        if len(others) > RESERVED - FREQUENT:
            raise ValueError("more distinct tokens than 32 bits tell apart")
        hashes = np.array([*often, *others], np.int64)
        numbers = np.r_[np.arange(len(often)), FREQUENT + np.arange(len(others))].astype(np.uint32)
        order = np.argsort(hashes)
        return seed, hashes[order], numbers[order]
    raise ValueError("tokens can't be told apart by their hashes")


def encoded(sets: DataFrame, seed: int, hashes: np.ndarray, numbers: np.ndarray) -> DataFrame:
    """(id, n, rare, often, key) of the sets (id, tokens) that aren't empty: their tokens' numbers, descending, as bytes of four and of two, and what equal sets have in common."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                h, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                token = (h & LOW).astype(np.uint32)
                if len(hashes):
                    i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    token = np.where(hashes[i] == h, numbers[i], token)
                row = np.repeat(np.arange(len(sizes)), sizes)
                key = np.sort((row << 32) | (LOW - token.astype(np.int64)))
                row, token = key >> 32, (LOW - (key & LOW)).astype(np.uint32)
                rare = token >= FREQUENT
                cut = np.bincount(row[rare], minlength=len(sizes)).cumsum() * 4, np.bincount(row[~rare], minlength=len(sizes)).cumsum() * 2
                raw = [x.tobytes() for x in (token[rare], token[~rare].astype(np.uint16))]
                cols = [pa.array([b[s:e] for s, e in zip([0, *c[:-1]], c, strict=True)], pa.binary()) for b, c in zip(raw, cut, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int32)), *cols], names=["id", "n", "rare", "often"])

    hashed = sets.where(F.size("tokens") > 0).select("id", F.transform("tokens", lambda t: F.xxhash64(F.lit(seed), t)).alias("h"))
    out = hashed.mapInArrow(run, f"id {kind}, n int, rare binary, often binary")
    return out.withColumn("key", F.unhex(F.sha2(F.concat(F.concat("n", F.lit(":")).cast("binary"), "rare", "often"), 256)))


def blocks_of(sizes: list[tuple[int, int]], least: float, block: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(first cell, lo, hi, parts, salts): blocks of the classes of lo to hi tokens, dealt into parts; those that ask a part are dealt into salts. sizes: (n, classes), ascending."""
    tokens = sum(n * c for n, c in sizes)
    block = block or min(BLOCK, max(LEAST_BLOCK, tokens // 6))
    spans: list[list[int]] = []
    for n, c in sizes:
        if spans and spans[-1][2] + n * c <= block:
            spans[-1][1:] = [n, spans[-1][2] + n * c]
        else:
            spans.append([n, n, n * c])
    out, cell = [], 0
    for lo, hi, held in spans:
        parts, asking = -(-held // block), sum(n * c for n, c in sizes if n >= lo and n * least - 1e-9 <= hi)
        out.append((cell, lo, hi, parts, max(1, -(-asking // block))))
        cell += parts * out[-1][-1]
    return out


def _tokens(cols: list[np.ndarray | pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows, where each row's begin) of binary columns rare and often."""
    parts = []
    for col, kind in zip(cols, (np.uint32, np.uint16), strict=True):
        ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        parts.append((raw.view(kind) if len(raw) else np.zeros(0, kind), np.diff(ends) // np.dtype(kind).itemsize))
    (rare, r), (often, o) = parts
    at = np.r_[0, (r + o).cumsum()].astype(np.int64)
    out = np.empty(at[-1], np.uint32)
    out[np.repeat(at[:-1] - np.r_[0, r.cumsum()[:-1]], r) + np.arange(len(rare))] = rare
    out[np.repeat(at[:-1] + r - np.r_[0, o.cumsum()[:-1]], o) + np.arange(len(often))] = often
    return out, at


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    before = lengths.cumsum() - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _chunks(lengths: np.ndarray, most: int | None = None) -> Iterator[slice]:
    """Slices of about AT_ONCE in all and of most at most, or of one."""
    ends, at = lengths.cumsum(), 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        end = min(end, at + most) if most else end
        yield slice(at, end)
        at = end


class Held:
    """A block: classes in order of n and number, their tokens, and postings of the rarest ones of each."""

    def __init__(self, rows: list[tuple], least: float):
        self.least = least
        self.cls, self.n, self.kind = (np.concatenate([r[i] for r in rows]) for i in range(3))
        ends = np.cumsum([len(r[3]) for r in rows])
        tokens = np.concatenate([r[3] for r in rows])
        self.at = np.concatenate([[0], *[r[4][1:] + e - len(r[3]) for r, e in zip(rows, ends, strict=True)]])
        self.vocabulary, inverse = np.unique(tokens, return_inverse=True)
        self.tokens = inverse.astype(np.int32)
        kept = self.n - np.ceil(self.n * (2 * least / (1 + least)) - 1e-9).astype(np.int64) + 1
        self.rest = self.n - kept
        self.last = tokens[self.at[:-1] + kept - 1]
        of = np.repeat(np.arange(len(kept), dtype=np.int32), kept)
        prefix = self.tokens[_runs(self.at[:-1], kept)]
        order = np.argsort(prefix, kind="stable")
        self.posts = of[order]
        self.starts = np.r_[0, np.bincount(prefix, minlength=len(self.vocabulary)).cumsum()]
        # Tokens of two bytes are looked up by their number.
        self.place = np.zeros(TWO_BYTES, np.int64)
        low = self.vocabulary[self.vocabulary < TWO_BYTES]
        self.place[low] = np.arange(len(low))
        self.bits = None

    def ask(self, cls: np.ndarray, n: np.ndarray, kind: np.ndarray, tokens: np.ndarray, at: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(place of the one that asks, place of the class here, shared tokens) of pairs that reach the limit; both: classes of both tables meet, too."""
        i = self.place[np.minimum(tokens, TWO_BYTES - 1)]
        other = np.flatnonzero(tokens >= TWO_BYTES)
        i[other] = np.minimum(np.searchsorted(self.vocabulary, tokens[other]), len(self.vocabulary) - 1)
        known = self.vocabulary[i] == tokens
        yield from self._ask(cls, n, kind, tokens, at, i, known, both)

    def _ask(self, cls: np.ndarray, n: np.ndarray, kind: np.ndarray, tokens: np.ndarray, at: np.ndarray, i: np.ndarray, known: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """ask(), where i are the tokens' places in the vocabulary, if they are known."""
        size, words, least = len(self.n), len(self.vocabulary), self.least
        of = np.repeat(np.arange(len(n)), n)
        kept = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
        asked = known & (np.arange(len(tokens)) - at[of] < kept[of])
        word, who = i[asked], of[asked]
        lengths = self.starts[word + 1] - self.starts[word]
        if lengths.sum() > min(AT_ONCE, len(n) * size // SPARSE):
            for s in range(0, len(n), STRIP) if len(n) > STRIP else []:
                e = min(s + STRIP, len(n))
                some = slice(at[s], at[e])
                for a, b, shared in self._ask(cls[s:e], n[s:e], kind[s:e], tokens[some], at[s : e + 1] - at[s], i[some], known[some], both):
                    yield a + s, b, shared
            if len(n) <= STRIP:
                yield self._counted(cls, n, kind, at, i, known, both)
            return
        met, counts = np.unique(np.repeat(who * size, lengths) + self.posts[_runs(self.starts[word], lengths)], return_counts=True)
        a, b = met // size, met % size
        # Of two sets the smaller one is held and the larger asks, of equally large ones that of the larger number.
        later = (n[a] > self.n[b]) | ((n[a] == self.n[b]) & (cls[a] > self.cls[b]))
        fits = later & (self.n[b] >= n[a] * least - 1e-9) & (both | (kind[a] != 3) | (self.kind[b] != 3))
        needed = (n[a] + self.n[b]) * (least / (1 + least)) - 1e-9
        # What isn't counted follows the end of that prefix which ends at the rarer token.
        last = tokens[at[:-1] + kept - 1]
        may = fits & (counts + np.where(last[a] >= self.last[b], (n - kept)[a], self.rest[b]) >= needed)
        a, b = a[may], b[may]
        shared = np.zeros(len(a), np.int64)
        if len(a):
            mine = np.sort(of[known] * words + i[known])
            for some in _chunks(self.n[b]):
                held = self.n[b[some]]
                theirs = np.repeat(a[some] * words, held) + self.tokens[_runs(self.at[b[some]], held)]
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                shared[some] = np.add.reduceat(hit, held.cumsum() - held, dtype=np.int64)
        enough = shared / (n[a] + self.n[b] - shared) >= least
        yield a[enough], b[enough], shared[enough]

    def _split(self) -> None:
        """The common tokens, those below a number, as bits of each class; postings of all others."""
        size, share = len(self.n), 2 * self.least / (1 + self.least)
        # Two equally large sets that share no other tokens are to fall short of the limit.
        held = np.bincount(self.tokens, minlength=len(self.vocabulary))[self.vocabulary < COMMON]
        below = np.bincount(self.vocabulary[: len(held)], held, COMMON).cumsum()
        self.common = max(64, min(int(np.searchsorted(below, 0.85 * share * len(self.tokens))), BITS // size, COMMON) // 64 * 64)
        first = int(np.searchsorted(self.vocabulary, self.common))
        self.bits = np.empty((size, self.common // 64), np.uint64)
        step = 16 * AT_ONCE // COMMON
        for s in range(0, size, step):
            e = min(s + step, size)
            self.bits[s:e] = self._as_bits(self.n[s:e], self.tokens[self.at[s] : self.at[e]], self.tokens[self.at[s] : self.at[e]] < first)
        self.few = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.least_shared = np.floor(self.n * (self.least / (1 + self.least)) - 1e-9).astype(np.int64)
        others = self.tokens >= first
        word, of = self.tokens[others], np.repeat(np.arange(size, dtype=np.int32), self.n)[others]
        self.others = of[np.argsort(word, kind="stable")]
        self.begins = np.r_[0, np.bincount(word, minlength=len(self.vocabulary)).cumsum()]

    def _as_bits(self, n: np.ndarray, places: np.ndarray, common: np.ndarray) -> np.ndarray:
        has = np.zeros((len(n), self.common), bool)
        has[np.repeat(np.arange(len(n)), n)[common], self.vocabulary[places[common]]] = True
        return np.packbits(has, axis=1).view(np.uint64)

    def _counted(self, cls: np.ndarray, n: np.ndarray, kind: np.ndarray, at: np.ndarray, i: np.ndarray, known: np.ndarray, both: bool) -> tuple[np.ndarray, ...]:
        """ask() of a strip by a count for each class that a set may meet."""
        if self.bits is None:
            self._split()
        share = self.least / (1 + self.least)
        mine = self._as_bits(n, i, known & (self.vocabulary[i] < self.common))
        few = np.bitwise_count(mine).sum(1, dtype=np.int64)
        # The smaller set is held and the larger asks, of equally large ones that of the larger number.
        lo = np.searchsorted(self.n, n * self.least - 1e-9)
        left, right = np.searchsorted(self.n, n), np.searchsorted(self.n, n, "right")
        found = []
        for a in range(len(n)):
            end = left[a] + np.searchsorted(self.cls[left[a] : right[a]], cls[a])
            if lo[a] >= end:
                continue
            here = slice(lo[a], end)
            word = i[at[a] : at[a + 1]][known[at[a] : at[a + 1]]]
            runs = [self.others[s:e] for s, e in zip(self.begins[word].tolist(), self.begins[word + 1].tolist(), strict=True) if s < e]
            counts = np.bincount(np.concatenate(runs, dtype=np.intp), minlength=len(self.n))[here] if runs else np.zeros(end - lo[a], np.intp)
            may = np.minimum(self.few[here], few[a])
            may += counts
            may -= self.least_shared[here]
            b = np.flatnonzero(may >= math.floor(n[a] * share - 1e-9))
            found.append((np.full(len(b), a), b + lo[a], counts[b]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        a, b, shared = (np.concatenate(x) for x in zip(*found, strict=True))
        for some in _chunks(np.full(len(a), self.common // 64)):
            shared[some] += np.bitwise_count(self.bits[b[some]] & mine[a[some]]).sum(1, dtype=np.int64)
        enough = (shared / (n[a] + self.n[b] - shared) >= self.least) & (both | (kind[a] != 3) | (self.kind[b] != 3))
        return a[enough], b[enough], shared[enough]


def _met(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(x, y, similarity) from rows (cell, asks, cls, n, kind, rare, often), in order of cell, asks, n and cls."""
    cell, held, block = None, [], None
    for batch in batches:
        cells, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1, len(cells)] if len(cells) else [0]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if cells[start] != cell:
                cell, held, block = cells[start], [], None
            whole = batch.slice(start, end - start)
            for some in _chunks(whole.column(3).to_numpy().astype(np.int64), WIDE) if asks[start] else [slice(0, end - start)]:
                part = whole.slice(some.start, some.stop - some.start)
                cls, n, kind = (part.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
                tokens, begins = _tokens([part.column(5), part.column(6)])
                if not asks[start]:
                    held.append((cls, n, kind, tokens, begins))
                    continue
                if held and block is None:
                    block, held = Held(held, least), []
                if block is not None:
                    for a, b, shared in block.ask(cls, n, kind, tokens, begins, cell % 2 == 0):
                        yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(block.cls[b]), pa.array(shared / (n[a] + block.n[b] - shared))], names=["x", "y", "similarity"])


def similar_classes(classes: DataFrame, least: float, alone: bool, block: int | None = None) -> DataFrame:
    """(x, y, similarity) of pairs of different classes, each once. classes: cls, n, kind, rare, often; kind: 1 of the left table, 2 of the right, 3 of both, as all are if one table is alone."""
    sizes = [(r["n"], r["c"]) for r in classes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy("n").collect()]
    grid = blocks_of(sizes, least, block)
    if not grid:
        return classes.sparkSession.createDataFrame([], "x long, y long, similarity double")
    cells = classes.sparkSession.createDataFrame(grid, "first long, lo int, hi int, parts long, salts long")
    h = F.pmod(F.xxhash64("cls"), F.lit(1 << 40))
    met = classes.withColumn("h", h).join(F.broadcast(cells), (F.col("n") >= F.col("lo")) & (F.col("n") * least - 1e-9 <= F.col("hi")))
    part, salt = F.pmod("h", "parts"), F.pmod(F.floor(F.col("h") / F.col("parts")), F.col("salts"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda p, s: F.col("first") + p * F.col("salts") + s
    here = F.when(F.col("n") <= F.col("hi"), F.transform(every("salts"), lambda s: F.struct(place(part, s).alias("cell"), F.lit(0).alias("asks"))))
    there = F.transform(every("parts"), lambda p: F.struct(place(p, salt).alias("cell"), F.lit(1).alias("asks")))
    out, n_cells = [], 0
    # Even cells hold classes of the left table, asked by those of the right one; odd ones the other way round, where classes of both have met already.
    for odd, (holds, asking) in enumerate([((1, 3), (2, 3))] if alone else [((1, 3), (2, 3)), ((2, 3), (1, 3))]):
        sent = F.concat(F.when(F.col("kind").isin(*holds), F.coalesce(here, F.array())).otherwise(F.array()), F.when(F.col("kind").isin(*asking), there).otherwise(F.array()))
        out.append(met.select(F.explode(sent).alias("to"), "cls", "n", "kind", "rare", "often").select((F.col("to.cell") * 2 + odd).alias("cell"), "to.asks", "cls", "n", "kind", "rare", "often"))
        n_cells += grid[-1][0] + grid[-1][3] * grid[-1][4]
    rows = out[0] if alone else out[0].unionByName(out[1])
    # More partitions than cells, so that few hold two.
    rows = rows.repartition(4 * n_cells, "cell").sortWithinPartitions("cell", "asks", "n", "cls")
    return written(rows.mapInArrow(lambda batches: _met(batches, least), "x long, y long, similarity double"), "similar")


def similar_pairs(left: DataFrame, right: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs of a left and a right set with Jaccard similarity of at least least. Both: id, tokens (a set)."""
    alone = left is right
    # Texts are cut into tokens once; these are read for the vocabulary and for the sets.
    tables = [written(df.select("id", "tokens"), "words") for df in ([left] if alone else [left, right])]
    both = tables[0].select("tokens") if alone else tables[0].select("tokens").unionByName(tables[1].select("tokens"))
    known = vocabulary(both.select(F.explode("tokens").alias("token")))
    rows = [written(encoded(df, *known), "sets") for df in tables]
    sets = None
    for kind, df in zip([3] if alone else [1, 2], rows, strict=True):
        df = df.groupBy("key").agg(F.first("n").alias("n"), F.lit(kind).alias("kind"), F.first("rare").alias("rare"), F.first("often").alias("often"))
        sets = df if sets is None else sets.unionByName(df)
    if not alone:
        sets = sets.groupBy("key").agg(F.first("n").alias("n"), F.sum("kind").cast("int").alias("kind"), F.first("rare").alias("rare"), F.first("often").alias("often"))
    classes = written(sets.withColumn("cls", F.monotonically_increasing_id()), "classes")
    met = similar_classes(classes, least, alone, block)
    met = met.unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity")).unionByName(classes.where("kind = 3").select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("similarity")))
    ids = [df.select("key", "id").join(classes.select("key", "cls"), "key").select("id", "cls") for df in (rows * 2 if alone else rows)]
    out = met.join(ids[0].select(F.col("id").alias("a"), F.col("cls").alias("x")), "x").join(ids[1].select(F.col("id").alias("b"), F.col("cls").alias("y")), "y")
    return out.select("a", "b", "similarity")
