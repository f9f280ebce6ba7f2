"""Sharding by minimax contiguous partition of atomic groups.

Rows of equal text form a group that stays whole. Groups are ordered by a hash of the text; the ordered list is
cut into at most n_shards runs so that the largest run's size is as small as any contiguous partition allows.

The capacity is found by binary search with greedy checks. The driver holds atoms: sums over ranges of the hash, and
single groups. Groups of more than 1 / 2**HOT_BITS of all bytes are atoms from the start; ranges in which a greedy cut
of any capacity still possible can fall are split into PARTS, again and again, until each such atom is one group. So
what is collected depends on the number of shards, not on the number of groups nor on how large one of them is.

Where a large group sets the capacity the greedy cuts would leave shards empty. The cuts are therefore moved to the
left, as near to even loads as the groups and the capacity allow: the largest shard stays as small as it can be.

Defined cases: a null text has no bytes and groups with empty texts; a null or repeated id is a row like any
other; an empty table gives no rows; columns other than the id and the text are dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gapless_index, materialize

#: Ranges of the hash at first, and their number that a range is split into.
FIRST_BITS, PARTS = 16, 64
HOT_BITS = 14
CELL_ROWS = 4096


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """First indices of the shards after the first, filling each as far as it goes; None if shards don't suffice."""
    total = np.cumsum(sizes)
    cuts, at = [], 0
    while True:
        used = int(total[at - 1]) if at else 0
        nxt = int(np.searchsorted(total, used + capacity, "right"))
        if nxt >= len(sizes):
            return cuts
        if nxt == at or len(cuts) + 1 >= shards:
            return None
        cuts.append(nxt)
        at = nxt


def smallest_capacity(sizes: np.ndarray, shards: int, low: int = 0, high: int | None = None) -> int:
    """The least capacity that greedy_cuts can meet, by binary search."""
    low = max(low, int(sizes.max()), -(-int(sizes.sum()) // shards))
    high = int(sizes.sum()) if high is None else high
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def open_atoms(sizes: np.ndarray, whole: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Atoms, other than whole ones (single groups), within which a greedy cut of some capacity from low to high can fall."""
    total = np.r_[0, np.cumsum(sizes)]
    out, early, late = np.zeros(len(sizes), bool), 0, 0  # the least and the most that can lie before the cut
    for _ in range(shards - 1):
        first = int(np.searchsorted(total, early + low, "right")) - 1
        last = int(np.searchsorted(total, late + high, "right")) - 1
        if first >= len(sizes):
            break
        out[first : last + 1] = True
        early = int(total[first])
        late = int(total[last]) if last >= len(sizes) or whole[last] else late + high
    return np.flatnonzero(out & ~whole)


def even_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """First indices of the shards after the first, near even loads, none above a capacity that greedy_cuts meets."""
    total = np.r_[0, np.cumsum(sizes)]
    ordered, n = np.sort(sizes)[::-1][: shards - 1], 0
    while n < len(ordered) and ordered[n] * (shards - n) > total[-1] - ordered[:n].sum():
        n += 1  # larger than an even share of the rest: a shard of its own
    share = (total[-1] - ordered[:n].sum()) / (shards - n)
    cuts, at = [], 0
    while len(cuts) + 1 < shards and at < len(sizes):
        most = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        near = max(at + 1, int(np.searchsorted(total, total[at] + share, "left")))
        if near > at + 1 and total[min(near, len(sizes))] - total[at] - share > total[at] + share - total[near - 1]:
            near -= 1
        cut = min(near, most)
        if cut >= len(sizes):
            break
        left = greedy_cuts(sizes[cut:], capacity, shards - len(cuts) - 1)
        at = cut if left is not None else most
        if at >= len(sizes):
            break
        cuts.append(at)
    return cuts


def _sums(groups: DataFrame, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and numbers of the groups between the breaks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(breaks), np.int64), np.zeros(len(breaks), np.int64)
        for batch in batches:
            at = np.searchsorted(breaks, batch.column(0).to_numpy().astype(np.int64), "right") - 1
            np.add.at(size, at, batch.column(1).to_numpy().astype(np.int64))
            n += np.bincount(at, minlength=len(breaks))
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(size[found]), pa.array(n[found])], names=["at", "size", "n"])

    found = groups.select("g", "size").mapInArrow(run, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toArrow()
    size, n = np.zeros(len(breaks), np.int64), np.zeros(len(breaks), np.int64)
    at = found.column(0).to_numpy()
    size[at], n[at] = found.column(1).to_numpy(), found.column(2).to_numpy()
    return size, n


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """Ordered-hash values at which shards after the first begin. groups: g (hash, distinct), size (long)."""
    stats = groups.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("top"), F.sum("size").alias("total")).first()
    if not stats["n"]:
        return []
    low = max(stats["top"], -(-stats["total"] // shards))
    hot = groups.where(F.col("size") > stats["total"] / (1 << HOT_BITS)).select("g").collect()  # 2**HOT_BITS rows at most
    bits = max(6, min(FIRST_BITS, (stats["n"] // 4).bit_length()))
    alone = [g for r in hot for g in (r["g"], r["g"] + 1) if g < 1 << 63]
    breaks = np.unique(np.array([*range(-(1 << 63), 1 << 63, 1 << (64 - bits)), *alone], np.int64))
    while True:
        sizes, n = _sums(groups, breaks)
        kept = np.flatnonzero(n)
        sizes, whole = sizes[kept], n[kept] == 1
        # Closed ranges count as one atom; a greedy cut never falls inside one, so the search over the mixed list is exact.
        high = smallest_capacity(sizes, shards, low)
        wide = open_atoms(sizes, whole, low, high, shards)
        if not len(wide):
            return [int(breaks[kept[i]]) for i in even_cuts(sizes, high, shards)]
        ends = [*map(int, breaks[1:]), 1 << 63]
        more = [a + (ends[k] - a) * i // PARTS for k in kept[wide].tolist() for a in [int(breaks[k])] for i in range(1, PARTS)]
        breaks = np.unique(np.concatenate([breaks, np.array(more, np.int64)]))


def shard_by_bytes(df: DataFrame, shards: int, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and overhead), text_crc32, shard and slot of every row; slot counts from 0 in the shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("g")), "shard-rows")
    groups = materialize(rows.groupBy("g").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = cut_points(groups, shards)
    shard = sum(((F.col("g") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    rows = rows.withColumn("shard", shard)
    cells = max(1, rows.count() // (shards * CELL_ROWS))
    # The id takes part, so that a large group of equal texts is dealt over many cells.
    placed = gapless_index(rows, ["shard"], F.pmod(F.xxhash64("doc_id", "g"), F.lit(cells)), ["doc_id", "g"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def shard_of(cuts: list[int], g: int) -> int:
    """The shard of an ordered-hash value, as the query's expression computes it."""
    return bisect_right(cuts, g)
