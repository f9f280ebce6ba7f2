"""Vectors: cosine distance, top-k, all pairs within a distance, greedy clusters, inequality-kNN."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed, written

#: Vectors of a block at most, on average: a task holds two blocks.
BLOCK = 16384
#: Vectors of a block at least where there is one cell.
LEAST_BLOCK = 512
#: Rows whose products with a block are taken, or that are sent to cells, at a time.
STRIP = 64
#: Tasks of a join at most; a task may take several keys.
MOST_TASKS = 4096
#: Pairs of an Arrow batch at most.
PAIRS = 1 << 17
#: The most centres of cells; every task holds them.
MOST_CENTRES = 1024
#: What angles are widened by, in radians: more than rounding can add up to.
SLACK = 1e-6
#: Ranges of rows that greedy clusters are found in, at most.
RANGES = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where either vector is zero: it has no direction, so it is like none and unlike none."""
    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def _unit(vectors: pd.Series) -> np.ndarray:
    """The vectors at length 1, zero ones as they are."""
    v = np.stack(vectors.to_list()).astype(np.float64)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows: (id, distance), nearest first, ties by id. The query is a literal, so the plan is a scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), cosine_distance(F.col(vector_col), q).alias("distance")).orderBy("distance", "id").limit(k)


def _near(batches: Iterable[pa.RecordBatch], distance: float, within: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of rows within the distance, from rows (cell, x, y, asks, id, v) in this order: those that ask meet those that don't, a strip at a time.

    within: keys with x = y hold a block and itself, of whose pairs those with a < b are taken. A task holds one block as a matrix.
    """

    def unit(v: pa.Array) -> np.ndarray:
        m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    last, held, block, ids = None, [], None, None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else [0]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[start, :3])
            if key != last:
                last, held, block = key, [], None
            if not keys[start, 3]:
                held.append((batch.column(4).slice(start, end - start), unit(batch.column(5).slice(start, end - start))))
                continue
            if held:
                ids, block, held = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]).T, []
            for at in range(start, end, STRIP) if block is not None else ():
                n = min(STRIP, end - at)
                d = 1 - unit(batch.column(5).slice(at, n)) @ block
                i, j = np.nonzero(d <= distance)
                for some in range(0, len(i), PAIRS):
                    p, q = i[some : some + PAIRS], j[some : some + PAIRS]
                    out = pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(at + p)), ids.take(pa.array(q)), pa.array(d[p, q])], names=["a", "b", "distance"])
                    yield out.filter(pc.less(out.column(0), out.column(1))) if within and key[1] == key[2] else out


def _angles(vectors: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angle of each vector with each centre, and which vectors have a direction at all."""
    unit = _unit(vectors)
    return np.arccos(np.clip(unit @ centres.T, -1, 1)), unit.any(axis=1)


class Cells:
    """Cells around some of the rows' directions, for finding pairs within a distance without comparing all.

    A row lies in the cell of the centre that it makes the least angle with; a cell's radius is the largest such angle. By the triangle
    inequality a row can only have a partner in a cell whose centre it sees at the cell's radius and the limit together, so it
    is sent to those cells alone. Cells of many rows are dealt into blocks. What the driver and every task hold are the
    centres with their radii and counts. For distances that reach a right angle or more there is one cell, as for those at which cells
    prune too little to be worth their copies (plain).
    """

    def __init__(self, rows: DataFrame, distance: float, id_col: str, vector_col: str, plain: bool = False):
        self.limit, self.all = (math.acos(1 - distance) + SLACK if distance < 1 else 2 * math.pi), plain or distance >= 1
        self.rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
        self.kind = rows.schema[id_col].dataType.simpleString()
        n = self.n = self.rows.count()
        block = self.block = max(1, min(BLOCK, max(LEAST_BLOCK, n // 8))) if self.all else BLOCK
        wanted = 1 if self.all else max(1, min(MOST_CENTRES, math.isqrt(n)))
        some = self.rows.where(dot(F.col("v"), F.col("v")) > 0).orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
        self.centres = _unit(pd.Series([r["v"] for r in some])) if some else np.zeros((0, 0))
        self.radius, self.blocks = np.zeros(len(self.centres)), np.ones(len(self.centres), np.int64)
        self.sizes = np.zeros(len(self.centres), np.int64)
        if some:
            centres, all_ = self.centres, self.all

            def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    if len(batch):
                        a, some_direction = _angles(batch["v"], centres)
                        keep = some_direction | all_
                        yield pd.DataFrame({"cell": a.argmin(axis=1)[keep], "angle": a.min(axis=1)[keep]})

            for r in self.rows.mapInPandas(own, "cell long, angle double").groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
                self.radius[r["cell"]], self.blocks[r["cell"]], self.sizes[r["cell"]] = r["radius"], -(-r["n"] // block), r["n"]

    def residents(self) -> DataFrame:
        """(cell, block, id, v) of the rows in their own cells' blocks."""
        centres, blocks, all_, kind = self.centres, self.blocks, self.all, self.kind

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    a, some_direction = _angles(batch["v"], centres)
                    out = batch.assign(cell=a.argmin(axis=1))[some_direction | all_]
                    yield out.assign(block=out["h"] % blocks[out["cell"]])[["cell", "block", "id", "v"]]

        return self.rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).mapInPandas(run, f"cell long, block long, id {kind}, v array<double>") if len(self.centres) else self._none("cell long, block long")

    def guests(self, rows: DataFrame, id_col: str, vector_col: str, after_own: bool) -> DataFrame:
        """(cell, part, id, v) of rows in each cell that can hold a partner. after_own: only in cells after the row's own, as pairs of cells meet once."""
        centres, limit, all_ = self.centres, self.radius + self.limit, self.all
        kind = rows.schema[id_col].dataType.simpleString()
        sent = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(1 << 40)).alias("h")).where("v is not null")
        if not len(self.centres):
            return self._none("cell long, h long", kind)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), STRIP):
                    part = batch.iloc[at : at + STRIP]
                    a, some_direction = _angles(part["v"], centres)
                    goes = ((a <= limit) & some_direction[:, None]) | all_
                    if after_own:
                        goes &= np.arange(a.shape[1]) > a.argmin(axis=1)[:, None]
                    i, cell = np.nonzero(goes)
                    yield pd.DataFrame({"cell": cell, "h": part["h"].to_numpy()[i], "id": part["id"].to_numpy()[i], "v": part["v"].to_numpy()[i]})

        return sent.mapInPandas(run, f"cell long, h long, id {kind}, v array<double>")

    def _none(self, columns: str, kind: str | None = None) -> DataFrame:
        return self.rows.sparkSession.createDataFrame([], f"{columns}, id {kind or self.kind}, v array<double>")


def _counts(guests: DataFrame, cells: Cells) -> np.ndarray:
    out = np.zeros(max(1, len(cells.centres)), np.int64)
    for r in guests.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each cell
        out[r["cell"]] = r["n"]
    return out


def _worth(cells: Cells, sent: np.ndarray, rows: int, products: float) -> bool:
    """Whether cells are cheaper than one cell in blocks: fewer copies, or less than half of all products."""
    pruned = float((sent[: len(cells.sizes)] * cells.sizes).sum())
    return cells.all or not len(cells.centres) or sent.sum() <= rows * max(8, -(-cells.n // BLOCK)) or pruned < products / 2


def _of(values: np.ndarray) -> Column:
    """The value of the row's cell."""
    return F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell").cast("int"))


def _joined(rows: DataFrame, tasks: int, distance: float, kinds: tuple[str, str], within: bool) -> DataFrame:
    rows = rows.select("cell", "x", "y", "asks", "id", "v").repartition(max(1, min(MOST_TASKS, tasks)), "cell", "x", "y").sortWithinPartitions("cell", "x", "y", "asks")
    return rows.mapInArrow(lambda batches: _near(batches, distance, within), f"a {kinds[0]}, b {kinds[1]}, distance double")


def _met(residents: DataFrame, guests: DataFrame, sent: np.ndarray, cells: Cells, distance: float, kinds: tuple[str, str]) -> DataFrame:
    """(a, b, distance) of guests a and residents b within the distance: each block of a cell's residents meets each part of its guests in one task."""
    parts = np.maximum(1, -(-sent // cells.block))
    blocks = cells.blocks if len(cells.blocks) else np.ones(1, np.int64)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (_of(n) - 1).cast("long")))
    left = guests.withColumn("y", F.pmod("h", _of(parts)).cast("long")).withColumn("x", every(blocks)).withColumn("asks", F.lit(1).cast("long"))
    right = residents.withColumnRenamed("block", "x").withColumn("y", every(parts)).withColumn("asks", F.lit(0).cast("long"))
    names = ["cell", "x", "y", "asks", "v"]
    if kinds[0] != kinds[1]:
        left, right = (df.withColumn("id", F.col("id").cast("string")) for df in (left, right))
    found = _joined(left.select(*names, "id").unionByName(right.select(*names, "id")), int((parts * blocks).sum()), distance, kinds if kinds[0] == kinds[1] else ("string", "string"), False)
    return found.select(F.col("a").cast(kinds[0]).alias("a"), F.col("b").cast(kinds[1]).alias("b"), "distance")


def pairs_within(left: DataFrame, right: DataFrame, distance: float, left_id: str = "id", right_id: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, distance) of all pairs of a left and a right row within the distance. The right rows lie in cells; a left one is sent where partners can be."""
    cells = Cells(right, distance, right_id, vector_col)
    n = left.count()
    guests = cells.guests(left, left_id, vector_col, after_own=False)
    sent = _counts(guests, cells)
    if not _worth(cells, sent, n, float(n) * cells.n):
        cells = Cells(right, distance, right_id, vector_col, plain=True)
        guests = cells.guests(left, left_id, vector_col, after_own=False)
        sent = _counts(guests, cells)
    kinds = left.schema[left_id].dataType.simpleString(), cells.kind
    return _met(cells.residents(), guests, sent, cells, distance, kinds)


def pairs_among(rows: DataFrame, distance: float, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, distance) of the pairs of rows within the distance, each once, a < b.

    Rows meet those of their own cell, block by block, and of the cells after it that can hold a partner.
    """
    cells = Cells(rows, distance, id_col, vector_col)
    guests = cells.guests(rows, id_col, vector_col, after_own=True)
    sent = _counts(guests, cells)
    if not _worth(cells, sent, cells.n, cells.n**2 / 2):
        cells = Cells(rows, distance, id_col, vector_col, plain=True)
        guests, sent = cells.guests(rows, id_col, vector_col, after_own=True), np.zeros(1, np.int64)
    kind = cells.kind
    own = checkpointed(cells.residents())
    blocks = cells.blocks if len(cells.blocks) else np.ones(1, np.int64)
    other = F.sequence(F.lit(0).cast("long"), (_of(blocks) - 1).cast("long"))
    # A block holds the rows that those of a later one ask, and its own.
    role = lambda o, asks: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"), asks.cast("long").alias("asks"))
    roles = F.concat(F.transform(other, lambda o: role(o, F.col("block") > o)), F.array(role(F.col("block"), F.lit(1))))
    met = own.select("cell", F.explode(roles).alias("r"), "id", "v").select("cell", "r.x", "r.y", "r.asks", "id", "v")
    inside = _joined(met, int((blocks * (blocks + 1) // 2).sum()), distance, (kind, kind), True)
    both = inside if cells.all else inside.unionByName(_met(own, guests, sent, cells, distance, (kind, kind)))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").where("a <> b")


def seeds(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(a) of the rows that a greedy pass takes as clusters' first: in order of id, each row that has least rows near it or more (itself included) and
    isn't near an earlier first one. pairs: (a, b) both ways with a = b included.

    That is the lexicographically first independent set of the rows with enough near ones. It is found in rounds, on edges to smaller rows alone: in each,
    a task reads a range of rows in order and settles every row all of whose smaller partners are settled, by rounds before or by itself just now. So a long
    chain takes as many rounds as there are ranges (RANGES at most), a random graph few, and no task holds a component.
    """
    many = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a"), "seeds-many")
    kind = pairs.schema["a"].dataType.simpleString()
    edges = pairs.where("a > b").join(many, "a", "left_semi").join(many.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    tasks = max(1, min(RANGES, edges.rdd.getNumPartitions()))
    open_ = written(edges.repartitionByRange(tasks, "a").select(F.spark_partition_id().alias("r"), "a", "b", F.lit(None).cast("boolean").alias("first")), "seeds-edges")
    known = written(many.join(open_.select("a"), "a", "left_anti").select("a", F.lit(True).alias("first")), "seeds-known")
    done = known

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}  # this range's settled rows
        row, state = None, None  # state: False if near a first one, None if it can't be told yet, else True
        for batch in batches:
            new = []
            for a, b, first in zip(batch["a"], batch["b"], batch["first"], strict=True):
                if a != row:
                    if row is not None and state is not None:
                        found[row] = state
                        new.append((row, state))
                    row, state = a, True
                near_first = found.get(b) if first is None else bool(first)
                if near_first:
                    state = False
                elif near_first is None and state:
                    state = None
                # A row that is near a first one stays so whatever else it is near.
            yield pd.DataFrame(new, columns=["a", "first"]).astype({"first": "boolean"})
        if row is not None and state is not None:
            yield pd.DataFrame([(row, state)], columns=["a", "first"]).astype({"first": "boolean"})

    while not open_.isEmpty():
        told = open_.join(known.select(F.col("a").alias("of"), F.col("first").alias("now")), F.col("b") == F.col("of"), "left")
        told = written(told.select("r", "a", "b", F.coalesce("first", "now").alias("first")), "seeds-told")
        known = written(told.repartition(tasks, "r").sortWithinPartitions("r", "a", "b").select("a", "b", "first").mapInPandas(settle, f"a {kind}, first boolean"), "seeds-known")
        done = done.unionByName(known)
        open_ = written(told.join(known.select("a"), "a", "left_anti").select("r", "a", "b", "first"), "seeds-open")
    return done.where("first").select("a")


def greedy_clusters(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(seed, members) of clusters: in order of id, each row not yet in a cluster takes all rows near it, if they are least or more.

    pairs: (a, b) both ways with a = b included. A row of the result holds its own cluster.
    """
    return pairs.join(seeds(pairs, least), "a").groupBy(F.col("a").alias("seed")).agg(F.array_sort(F.collect_set("b")).alias("members"))


def newer_neighbours(old: DataFrame, new: DataFrame, distance: float, least: int = 3) -> DataFrame:
    """(id, members): for each old row the new rows within the distance that came after it, where they are least or more. Both: id, embedding, at."""
    near = pairs_within(old, new, distance)
    timed = near.join(old.select(F.col("id").alias("a"), F.col("at").alias("from")), "a").join(new.select(F.col("id").alias("b"), F.col("at").alias("made")), "b")
    return timed.where(F.col("made") > F.col("from")).groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list("b")).alias("members")).where(F.size("members") >= least)
