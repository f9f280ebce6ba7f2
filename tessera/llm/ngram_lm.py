"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

A gram is up to ORDER bytes of UTF-8, so every script is read as it is, and the tables of grams grow with the trusted
text; nothing is folded, hashed together or cut off. A gram's id holds its class, its order and its bytes. Training
counts the grams of the trusted documents in each task, adds the counts up by id, and computes every order's
probabilities by joins of id-sharded tables; a context has 256 grams at most, so no join has a hot key. The result is
a table (id, cost, bow): the cost of a seen gram, and the cost of backing off from it as a context.

Scoring looks grams up in two tiers. The most used entries, CACHE_ROWS at most, go to every worker, with a bit filter
of fixed size over all other entries. A gram found in the first, or proven absent by the second, is settled where the
document lies; the rest are counted for each document and joined with the table by id. So frequent grams are never
shuffled, what is shuffled is what the first tier can't settle, and the sums are the same whatever the tier.

One model is trained on all trusted text: five bytes tell languages apart, and no language is without one. Thresholds are the languages' own.
A document is kept if its mean cost a byte is at most its language's threshold plus SLACK / sqrt(bytes), as short texts vary more. A language's threshold is the
KEPT_SHARE quantile of mean cost less that slack over its trusted documents that were held out of training (over those it was trained on where none is held out),
drawn towards the same quantile of all languages: with n such documents it counts n times, the common one SHRINK times. So a language of no, few or
many trusted documents is judged by one rule, and its threshold moves by little with each document.

Defined cases: a null language is the language ''; a null or empty text has no perplexity and isn't kept; rows with a
null id are scored but never trusted; repeated rows are scored each by itself; without any trusted document there is
no threshold and every text that isn't empty is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import fresh, materialize

ORDER = 5
KEY_BITS = 8 * ORDER
CLASS_SHIFT = KEY_BITS + 3
#: Costs are whole numbers of 1 / SCALE nats, so sums don't depend on the order.
SCALE = 10_000
UNIFORM = round(math.log(256) * SCALE)
#: What a probability is at least.
FLOOR = 1e-9
#: Entries on every worker, and bits of the filter over the rest (16 MB each).
CACHE_ROWS, FILTER_BITS = 1 << 20, 27
#: Bytes read at a time, and distinct grams that a counting task holds.
WINDOW, HELD = 1 << 20, 1 << 21
HELD_OUT = 5
SLACK, KEPT_SHARE, SHRINK = 4.0, 0.998, 20.0
#: Salts of the short grams in the join, which many long ones share.
SALTS = 16

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every byte, WINDOW bytes at a time. A key is the ORDER bytes that end there, zeros before the row's first.

    data: the rows' bytes, one after the other, row i from offsets[i] to offsets[i + 1].
    """
    for a in range(int(offsets[0]), int(offsets[-1]), WINDOW):
        b = min(a + WINDOW, int(offsets[-1]))
        back = min(ORDER - 1, a)
        s = np.r_[np.zeros(ORDER - 1 - back, np.int64), data[a - back : b].astype(np.int64)]
        n, key = b - a, np.zeros(b - a, np.int64)
        for i in range(ORDER):
            key = key << 8 | s[i : i + n]
        row = np.searchsorted(offsets, np.arange(a, b), "right") - 1
        into = np.arange(a, b) - offsets[row]
        for j in range(ORDER - 1):
            first = into == j
            key[first] &= (1 << 8 * (j + 1)) - 1
        yield row, key


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def count_grams(docs: DataFrame) -> DataFrame:
    """docs: class (int), bytes. Rows (id, n) of the counts of ORDER-grams, added up within each task as far as HELD allows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=["id", "n"])

        for batch in batches:
            classes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, key in windows(*_bytes_of(batch.column(1))):
                new, n = np.unique(classes[row] << CLASS_SHIFT | ORDER << KEY_BITS | key, return_counts=True)
                ids, where = np.unique(np.concatenate([ids, new]), return_inverse=True)
                total = np.zeros(len(ids), np.int64)
                np.add.at(total, where, np.concatenate([counts, n]))
                counts = total
                if len(ids) > HELD:
                    yield made()
                    ids, counts = ids[:0], counts[:0]
        yield made()

    return docs.select("class", "bytes").mapInArrow(run, "id long, n long")


def _order(gram: Column) -> Column:
    return F.shiftright(gram, KEY_BITS).bitwiseAND(F.lit(7))


def _shorter(gram: Column, k: Column | int, key: Column) -> Column:
    """The id of an order-k gram of the same class."""
    order = (F.lit(k) if isinstance(k, int) else k).cast("long") * F.lit(1 << KEY_BITS)
    return F.shiftright(gram, CLASS_SHIFT) * F.lit(1 << CLASS_SHIFT) + order + key


def _suffix(gram: Column, k: int) -> Column:
    """The id of the last k bytes."""
    return _shorter(gram, k, gram.bitwiseAND(F.lit((1 << 8 * k) - 1)))


def _context(gram: Column, k: int) -> Column:
    """The id of all but the last byte of the last k bytes."""
    return _shorter(gram, k - 1, F.shiftright(gram.bitwiseAND(F.lit((1 << 8 * k) - 1)), 8))


def _per_order(gram: Column, of) -> Column:
    """of(gram, k) for the gram's own order k."""
    out = of(gram, 1)
    for k in range(2, ORDER + 1):
        out = F.when(_order(gram) == k, of(gram, k)).otherwise(out)
    return out


def gram_counts(top: DataFrame) -> DataFrame:
    """id and c of the grams of all orders: counts for the highest, for the others the number of distinct bytes before them."""
    longest = materialize(top.groupBy("id").agg(F.sum("n").alias("c")), "grams")
    longer = longest.select(F.explode(F.array(*[_suffix(F.col("id"), k) for k in range(2, ORDER + 1)])).alias("id")).distinct()
    last = _per_order(F.col("id"), lambda g, k: _suffix(g, max(1, k - 1)))
    lower = longer.groupBy(last.alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return materialize(longest.unionByName(lower), "gram-counts")


def discounts(n: list[float]) -> list[float]:
    """The three discounts of an order from its counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return found if any(found) else [0.5, 0.5, 0.5]


def train(docs: DataFrame) -> DataFrame:
    """The model of the documents (class, bytes): id, cost and bow (integers, either may be null), used (a count)."""
    spark = docs.sparkSession
    grams = gram_counts(count_grams(docs))
    kind = F.shiftright("id", KEY_BITS)
    # (MOST_CLASSES + 1) * ORDER rows at most.
    found = grams.groupBy(kind.alias("kind")).agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
    table = [(r["kind"], *map(float, discounts([r[f"n{i}"] for i in (1, 2, 3, 4)]))) for r in found]
    off = F.broadcast(spark.createDataFrame(table, "kind long, d1 double, d2 double, d3 double"))
    grams = grams.withColumn("of_kind", kind).join(off, F.col("of_kind") == F.col("kind"))
    grams = grams.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("at", _per_order(F.col("id"), _context))
    n = lambda cond: F.count_if(cond)
    left = (F.max("d1") * n(F.col("c") == 1) + F.max("d2") * n(F.col("c") == 2) + F.max("d3") * n(F.col("c") > 2)) / F.sum("c")
    contexts = materialize(grams.groupBy("at").agg(F.sum("c").alias("total"), F.greatest(left, F.lit(FLOOR)).alias("left")), "contexts")
    states, lower = [], None
    for k in range(1, ORDER + 1):
        mine = grams.where(_order(F.col("id")) == k).select("id", "c", "d", F.col("at").alias("a"), _suffix(F.col("id"), max(1, k - 1)).alias("s"))
        mine = mine.join(contexts.hint("merge"), F.col("a") == F.col("at"))
        base: Column = F.lit(1 / 256)
        if lower is not None:
            mine, base = mine.join(lower.select(F.col("id").alias("low"), F.col("p").alias("p_low")).hint("merge"), F.col("s") == F.col("low")), F.col("p_low")
        lower = materialize(mine.select("id", "c", F.greatest((F.col("c") - F.col("d")) / F.col("total") + F.col("left") * base, F.lit(FLOOR)).alias("p")), "probabilities")
        states.append(lower)
    units = lambda p: F.round(-F.log(p) * SCALE).cast("int")
    rows = contexts.select(F.col("at").alias("id"), F.lit(None).cast("int").alias("cost"), units(F.col("left")).alias("bow"), F.col("total").alias("used"))
    for s in states:
        rows = rows.unionByName(s.select("id", units(F.col("p")).alias("cost"), F.lit(None).cast("int").alias("bow"), F.col("c").alias("used")))
    return materialize(rows.groupBy("id").agg(F.max("cost").alias("cost"), F.max("bow").alias("bow"), F.max("used").alias("used")), "model")


def _filter_bits(ids: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint64) * _MIX[2]) >> np.uint64(64 - FILTER_BITS)


class Cache:
    """The first tier: entries in two hash tables, those that find both slots taken in order after them, and the filter of all others (None if there are none)."""

    def __init__(self, ids: np.ndarray, cost: np.ndarray, bow: np.ndarray, rest: np.ndarray | None):
        self.bits = [max(4, int(len(ids)).bit_length() + 1), max(4, int(len(ids)).bit_length())]
        self.ids, self.cost, self.bow = (np.full((1 << self.bits[0]) + (1 << self.bits[1]), -1, t) for t in (np.int64, np.int32, np.int32))
        left = np.arange(len(ids))
        for which in (0, 1):
            slot = self._slot(ids[left], which)
            taken, first = np.unique(slot, return_index=True)
            put = left[first]
            self.ids[taken], self.cost[taken], self.bow[taken] = ids[put], cost[put], bow[put]
            left = np.setdiff1d(left, put, assume_unique=True)
        left = left[np.argsort(ids[left])]
        self.base, self.more = len(self.ids), ids[left]
        self.ids, self.cost, self.bow = np.r_[self.ids, ids[left], -1], np.r_[self.cost, cost[left], -1], np.r_[self.bow, bow[left], -1]
        self.rest = rest

    def _slot(self, ids: np.ndarray, which: int) -> np.ndarray:
        base = which * (1 << self.bits[0])
        return ((ids.view(np.uint64) * _MIX[which]) >> np.uint64(64 - self.bits[which])).astype(np.int64) + base

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, known): slot -1 if the entry isn't here; known is False if it may be elsewhere."""
        slot = self._slot(ids, 0)
        miss = np.flatnonzero(self.ids[slot] != ids)
        if not len(miss):
            return slot, np.ones(len(ids), bool)
        second = self._slot(ids[miss], 1)
        third = np.flatnonzero(self.ids[second] != ids[miss])
        second[third] = self.base + np.searchsorted(self.more, ids[miss[third]])
        second[third[self.ids[second[third]] != ids[miss[third]]]] = -1
        slot[miss] = second
        known = np.ones(len(ids), bool)
        if self.rest is not None:
            gone = miss[second < 0]
            at = _filter_bits(ids[gone])
            known[gone] = (self.rest[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 0
        return slot, known

    def costs(self, ids: np.ndarray) -> np.ndarray:
        """The cost of each ORDER-gram, or -1 where this tier can't tell."""
        out = np.zeros(len(ids), np.int64)
        left, top = np.arange(len(ids)), ids >> CLASS_SHIFT << CLASS_SHIFT
        for k in range(ORDER, 0, -1):
            key = ids[left] & ((1 << 8 * k) - 1)
            slot, known = self.find(top[left] | k << KEY_BITS | key)
            cost = np.where(slot >= 0, self.cost[slot], -1)
            out[left[~known]] = -1
            hit = known & (cost >= 0)
            out[left[hit]] += cost[hit]
            on = np.flatnonzero(known & ~hit)
            left = left[on]
            if not len(left):
                return out
            slot, known = self.find(top[left] | k - 1 << KEY_BITS | key[on] >> 8)
            out[left[~known]] = -1
            out[left] += np.where(known & (slot >= 0), np.maximum(self.bow[slot], 0), 0)
            left = left[known]
        out[left] += UNIFORM
        return out


def cache_of(model: DataFrame, cache_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The arrays of a Cache: the most used entries, cache_rows at most, and the filter over the others."""
    level = F.floor(F.log2(F.col("used").cast("double"))).cast("int")
    sizes = sorted(((r["level"], r["n"]) for r in model.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 64 rows at most
    least, taken = 64, 0
    for at, n in sizes:
        if taken + n > cache_rows:
            break
        least, taken = at, taken + n
    most = model.where(level >= least).select("id", F.coalesce("cost", F.lit(-1)).alias("cost"), F.coalesce("bow", F.lit(-1)).alias("bow")).orderBy("id").toArrow()
    arrays = tuple(most.column(i).to_numpy() for i in range(3))
    if taken == sum(n for _, n in sizes):
        return *arrays, None

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for batch in batches:
            at = _filter_bits(batch.column(0).to_numpy().astype(np.int64))
            np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        found = seen.view(np.int64)
        where = np.flatnonzero(found)
        for i in range(0, len(where), 1 << 16):
            part = where[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found[part])], names=["word", "bits"])

    set_words = model.where(level < least).select("id").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    rest = np.zeros(1 << FILTER_BITS - 6, np.int64)
    rest[set_words.column(0).to_numpy()] = set_words.column(1).to_numpy()
    return *arrays, rest.view(np.uint8)


#: The table that this worker built last, by its model.
_BUILT: dict[str, Cache] = {}


def score(docs: DataFrame, model: DataFrame, cache_rows: int = CACHE_ROWS) -> DataFrame:
    """docs (class int, bytes, and columns that pass through, bytes without nulls) with cost (long, of the whole text) for bytes."""
    spark = docs.sparkSession
    first = cache_of(model, cache_rows)
    sent, name = spark.sparkContext.broadcast(first), uuid.uuid4().hex  # 16 bytes an entry and the filter
    keep = [c for c in docs.columns if c not in ("class", "bytes")]
    schema = StructType([*[docs.schema[c] for c in keep], docs.schema["class"], StructField("uid", LongType()), StructField("cost", LongType()), StructField("ids", ArrayType(LongType())), StructField("times", ArrayType(IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Cache(*sent.value)
        cache, uid = _BUILT[name], TaskContext.get().partitionId() << 40
        for batch in batches:
            n, n_keep = batch.num_rows, len(keep)
            classes = batch.column(n_keep).to_numpy(zero_copy_only=False).astype(np.int64)
            total, open_rows, open_ids = np.zeros(n, np.int64), [], []
            for row, key in windows(*_bytes_of(batch.column(n_keep + 1))):
                ids = classes[row] << CLASS_SHIFT | ORDER << KEY_BITS | key
                cost = cache.costs(ids)
                lo = int(row[0])
                total[lo : int(row[-1]) + 1] += np.bincount(row - lo, np.maximum(cost, 0)).astype(np.int64)
                unknown = cost < 0
                if unknown.any():
                    open_rows.append(row[unknown])
                    open_ids.append(ids[unknown])
            if open_rows:
                rows, ids = np.concatenate(open_rows), np.concatenate(open_ids)
                order = np.lexsort((ids, rows))
                rows, ids = rows[order], ids[order]
                new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])])
                times = np.diff(np.r_[new, len(rows)]).astype(np.int32)
                offsets = pa.array(np.searchsorted(rows[new], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(ids[new])), pa.ListArray.from_arrays(offsets, pa.array(times))]
            else:
                offsets = pa.array(np.zeros(n + 1, np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array([], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array([], pa.int32()))]
            cols = [*[batch.column(i) for i in range(n_keep + 1)], pa.array(uid + np.arange(n)), pa.array(total), *lists]
            uid += n
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    done = docs.select(*keep, "class", "bytes").mapInArrow(run, schema)
    if first[3] is None:
        return done.drop("uid", "ids", "times")
    done = materialize(done, "first-tier")
    tail = materialize(done.where(F.size("ids") > 0).select("uid", F.inline(F.arrays_zip("ids", "times"))), "second-tier")
    costs = resolve(tail.select(F.col("ids").alias("id")).distinct(), model)
    added = tail.join(costs.hint("merge"), F.col("ids") == F.col("id")).groupBy(F.col("uid").alias("for_uid")).agg(F.sum(F.col("times") * F.col("gram_cost")).alias("more"))
    whole = done.join(added, F.col("uid") == F.col("for_uid"), "left")
    return whole.withColumn("cost", F.col("cost") + F.coalesce("more", F.lit(0))).drop("uid", "ids", "times", "for_uid", "more")


def resolve(grams: DataFrame, model: DataFrame) -> DataFrame:
    """id and gram_cost of distinct ORDER-grams, by one join of all that they may back off to with the model."""
    g = F.col("id")
    parts = [F.struct(F.lit(2 * k).alias("role"), _suffix(g, k).alias("of")) for k in range(1, ORDER + 1)] + [F.struct(F.lit(2 * k + 1).alias("role"), _context(g, k).alias("of")) for k in range(1, ORDER + 1)]
    # Short grams are shared by many long ones: they are dealt over salts.
    salt = F.when(_order(F.col("of")) <= 2, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    wanted = grams.select("id", F.inline(F.array(*parts))).withColumn("salt", salt)
    salts = F.sequence(F.lit(0), F.when(_order(F.col("entry")) <= 2, F.lit(SALTS - 1)).otherwise(F.lit(0)))
    entries = model.select(F.col("id").alias("entry"), "cost", "bow").withColumn("entry_salt", F.explode(salts))
    met = wanted.join(entries.hint("merge"), (F.col("of") == F.col("entry")) & (F.col("salt") == F.col("entry_salt")), "left")
    one = met.groupBy("id").agg(*[F.max(F.when(F.col("role") == 2 * k, F.col("cost"))).alias(f"c{k}") for k in range(1, ORDER + 1)], *[F.max(F.when(F.col("role") == 2 * k + 1, F.col("bow"))).alias(f"b{k}") for k in range(1, ORDER + 1)])
    cost: Column = F.lit(UNIFORM)
    for k in range(1, ORDER + 1):
        cost = F.coalesce(F.col(f"c{k}"), F.coalesce(F.col(f"b{k}"), F.lit(0)) + cost)
    return one.select("id", cost.cast("long").alias("gram_cost"))


def thresholds(scored: DataFrame, mean: Column, room: Column, share: float = KEPT_SHARE, shrink: float = SHRINK) -> DataFrame:
    """of (a language, null for all others) and threshold, from scored documents (lang, held: whether a trusted one was held out, else null)."""
    # Histograms of 0.001 nats, so a language's rows are added up before they meet.
    bins = scored.where(F.col("held").isNotNull() & (F.col("n_bytes") > 0)).groupBy("lang", "held", F.ceil((mean - room) * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = materialize(bins, "threshold-bins")

    def quantiles(bins: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by, "held")
        placed = bins.groupBy(*by, "held", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
        each = placed.groupBy(*by, "held").agg(F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("bin"))).alias("q"), F.first("total").alias("total"))
        return each.groupBy(*by).agg(F.max_by(F.struct("q", "total"), "held").alias("x"))

    common = quantiles(bins.withColumn("one", F.lit(1)), "one").select(F.col("x.q").alias("all_q"))
    own = quantiles(bins, "lang").select(F.col("lang").alias("of"), F.col("x.q").alias("q"), F.col("x.total").alias("n"))
    every = own.unionByName(common.select(F.lit(None).cast("string").alias("of"), F.col("all_q").alias("q"), F.lit(0).cast("long").alias("n")))
    both = every.join(F.broadcast(common))  # a single row
    return both.select("of", F.round((F.col("n") * F.col("q") + shrink * F.col("all_q")) / (F.col("n") + shrink) / 1000, 4).alias("threshold"))


def classify(
    docs: DataFrame, trusted: DataFrame, held_out: int = HELD_OUT, slack: float = SLACK, share: float = KEPT_SHARE, shrink: float = SHRINK,
    id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", cache_rows: int = CACHE_ROWS,
) -> DataFrame:
    """doc_id, lang, n_chars, mean_cost (nats a byte), perplexity (of a byte), threshold and kept of every row. trusted: doc_id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.length(text).cast("long").alias("n_chars"), text.cast("binary").alias("bytes"))
    docs = docs.withColumn("class", F.lit(0))
    good = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    out_of = F.pmod(F.xxhash64("good_id"), F.lit(held_out)) == 0
    # A merge join, the same plan at every size: the ids grow with the documents.
    read = docs.join(good.where(~out_of).hint("merge"), F.col("doc_id") == F.col("good_id"), "left_semi").select("class", "bytes")
    scored = score(docs.withColumn("n_bytes", F.octet_length("bytes").cast("long")), train(read), cache_rows)
    scored = materialize(scored.join(good, F.col("doc_id") == F.col("good_id"), "left").withColumn("held", F.when(F.col("good_id").isNotNull(), out_of)).drop("good_id", "class"), "scores")
    mean, room = F.col("cost") / F.col("n_bytes") / F.lit(float(SCALE)), F.lit(slack) / F.sqrt("n_bytes")
    limits = materialize(thresholds(scored, mean, room, share, shrink), "thresholds")
    others = limits.where("of is null").select(F.col("threshold").alias("common"))
    out = scored.join(limits, F.col("lang") == F.col("of"), "left").join(F.broadcast(others), how="left")  # a single row, or none
    out = out.withColumn("threshold", F.coalesce("threshold", "common"))
    mean = F.when(F.col("n_bytes") > 0, mean)
    good_enough = F.col("threshold").isNull() | (mean <= F.col("threshold") + room)
    return out.select("doc_id", "lang", "n_chars", mean.alias("mean_cost"), F.exp(mean).alias("perplexity"), "threshold", F.when(F.col("n_bytes") > 0, good_enough).otherwise(False).alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept. Of rows that share an id all stay if any does; rows without an id stay."""
    (bad,) = fresh(docs, "bad_id")
    found = classify(docs, trusted_ids(labels), id_col=id_col, lang_col=lang_col, text_col=text_col)
    drop = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(bad)).agg(F.max("kept").alias("k")).where(~F.col("k")).select(bad)
    named = docs.where(F.col(id_col).isNotNull()).join(drop, F.col(id_col) == F.col(bad), "left_anti")
    return named.unionByName(docs.where(F.col(id_col).isNull()))
