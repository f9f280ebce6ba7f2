"""Centroid clustering of vectors with Hamerly's bounds.

Vectors are integers: the floor of a component times a scale. A vector keeps one upper bound of the distance to its centroid and
one lower bound of the distance to any other. When centroids move, the upper bound grows by the drift of the vector's own
centroid and the lower one shrinks by the largest drift of the others; as long as the upper bound stays below the lower one,
or below half the way from its centroid to the next, the vector can't change its cluster. The others, the ambiguous ones, are
compared with all centroids in exact integers, ties to the smaller number. So the clusters are those of plain rounds.

The vectors are written once, in buckets of their row numbers, and so are each round's bounds: a round joins them where they lie,
without a shuffle, and reads the vectors of the ambiguous rows and of those that moved. Sums of clusters are carried
forward by what rows that moved add and take away, and added up before they are shuffled, so a cluster that holds most rows
is no task. The driver holds the centroids and their sums only, which don't grow with the rows. A round's table replaces the one before it, whose
files are deleted.

Defined cases: a null vector, and one of another length or with a null or non-finite component, isn't clustered and not in the result;
components beyond 2**62 after scaling count as that, distances beyond the range of a long as the largest long; a
row without an id is clustered like any other but is no first centroid while others are left; repeated rows are rows of their
own; with fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows; other columns
pass through, and one that bears an output's name is replaced.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete, scratch_dir

#: Vectors of a bucket, and the most buckets that Spark allows by default.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 100_000
#: Vectors that are compared with the centroids at a time.
STRIP = 1024
#: What bounds are widened by, relatively: far above what rounding can add up to.
SLACK = 1e-9
#: Components of at most this size have squared distances within a long, for up to 128 of them.
EXACT = 1 << 27
LIMIT, LARGEST = 1 << 62, (1 << 63) - 1
STATE = "rid long, cluster int, was int, upper double, lower double"


def quantized(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))))


def usable(vector: Column, size: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~odd, F.lit(False))


def squared_distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact, a column for each centroid: 64-bit integers where they suffice, else Python's."""
    small = x.shape[1] <= 128 and max(abs(int(x.max())), abs(int(x.min())), *(max(map(abs, c)) for c in centroids)) <= EXACT
    own = x if small else x.astype(object)
    return np.stack([((own - np.array(c, np.int64 if small else object)) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and the bounds of the distances to it and to the others."""
    d = squared_distances(x, centroids)
    at, rows = d.argmin(axis=1), np.arange(len(d))
    upper = np.sqrt(d[rows, at].astype(np.float64)) * (1 + SLACK)
    rest = np.sqrt(d.astype(np.float64))
    rest[rows, at] = np.inf
    return at, upper, rest.min(axis=1) * (1 - SLACK)


def _strips(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with the vectors of their last column."""
    for batch in batches:
        for at in range(0, batch.num_rows, STRIP):
            part = batch.slice(at, STRIP)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _scanned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows (rid, was, x) compared with all centroids."""
    size = len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _strips(batches, size):
            at, upper, lower = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.int32()), part.column(1), pa.array(upper), pa.array(lower)], ["rid", "cluster", "was", "upper", "lower"])

    return rows.select("rid", "was", "x").mapInArrow(run, STATE)


def _measured(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(rid, cluster, distance) of rows (rid, cluster, x): the squared distance to their own centroid."""
    size = len(centroids[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _strips(batches, size):
            d = squared_distances(x, centroids)[np.arange(len(x)), part.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([min(int(v), LARGEST) for v in d], pa.int64())], ["rid", "cluster", "distance"])

    return rows.select("rid", "cluster", "x").mapInArrow(run, "rid long, cluster int, distance long")


class _Buckets:
    """Tables in buckets of one number by rid, in the folder that driver and executors share."""

    def __init__(self, spark: SparkSession, number: int):
        self.spark, self.number, self.paths = spark, number, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table, path = f"{name}_{uuid.uuid4().hex}", scratch_dir(self.spark, name)
        df.write.format("parquet").bucketBy(self.number, "rid").sortBy("rid").option("path", path).saveAsTable(table)
        out = self.spark.read.table(table)
        self.paths[out] = table, path
        return out

    def drop(self, df: DataFrame) -> None:
        table, path = self.paths.pop(df)
        self.spark.sql(f"drop table {table}")
        delete(self.spark, path)


def bounds_after(state: DataFrame, old: list[list[int]], new: list[list[int]]) -> DataFrame:
    """state with its bounds loosened by the centroids' drift from old to new, and whether they are too loose to tell."""
    far = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    drift = [far(a, b) * (1 + SLACK) for a, b in zip(old, new, strict=True)]
    others = [max([*drift[:i], *drift[i + 1 :]], default=0.0) for i in range(len(drift))]
    half = [min([far(c, d) for j, d in enumerate(new) if j != i], default=math.inf) / 2 * (1 - SLACK) for i, c in enumerate(new)]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    loose = state.select("rid", "cluster", (F.col("upper") + of(drift)).alias("upper"), (F.col("lower") - of(others)).alias("lower"))
    return loose.withColumn("ambiguous", F.col("upper") >= F.greatest("lower", of(half)))


def _next(state: DataFrame, vectors: DataFrame, old: list[list[int]], new: list[list[int]]) -> DataFrame:
    loose = bounds_after(state, old, new)
    sure = loose.where(~F.col("ambiguous")).select("rid", "cluster", F.col("cluster").alias("was"), "upper", "lower")
    unsure = loose.where("ambiguous").select("rid", F.col("cluster").alias("was")).join(vectors.hint("merge"), "rid")
    return sure.unionByName(_scanned(unsure, new))


def _moves(state: DataFrame, vectors: DataFrame) -> list:
    """What rows in new clusters add to them and take from their old ones: (cluster, component, rows, sum), a bounded number."""
    moved = state.where(F.col("was").isNull() | (F.col("cluster") != F.col("was"))).join(vectors.hint("merge"), "rid")
    ends = F.array(F.struct(F.col("cluster").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("k"), F.lit(-1).alias("sign")))
    each = moved.select("x", F.explode(ends).alias("e")).where(F.col("e.k").isNotNull()).select("e.k", "e.sign", F.posexplode("x").alias("i", "q"))
    return each.groupBy("k", "i").agg(F.sum("sign").alias("n"), F.sum((F.col("q") * F.col("sign")).cast("decimal(38,0)")).alias("s")).collect()


def cluster(
    df: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", seen: Callable[[DataFrame, int], None] | None = None
) -> DataFrame:
    """The usable rows of df with cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Centroids begin as the vectors whose hashes of `seed:id` are least. seen, if given, is called with each round's state and number.
    """
    spark, outputs = df.sparkSession, ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    columns = [c for c in df.columns if c.lower() not in outputs]
    vector = F.col(f"`{vector_col}`")
    types = dict.fromkeys(("distance", "cluster_inertia", "inertia"), "long") | {"cluster": "int", "centroid_sha256": "string"}
    kept = df.where(usable(vector, size))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256)
    first = kept.select(hashed.alias("h"), quantized(vector, scale).alias("x")).orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()
    if not first:
        return df.limit(0).select(*[F.col(f"`{c}`") for c in columns], *[F.lit(None).cast(types[c]).alias(c) for c in outputs])
    centroids, rows = [list(r["x"]) for r in first], kept.count()
    cores = spark.sparkContext.defaultParallelism
    buckets = _Buckets(spark, max(1, min(MOST_BUCKETS, max(rows // BUCKET_ROWS, min(2 * cores, rows // STRIP)))))

    # Columns of df bear numbers meanwhile, so none clashes with those of the bounds.
    aside = {c: f"c{i}" for i, c in enumerate(columns)}
    whole = kept.select(*[F.col(f"`{c}`").alias(n) for c, n in aside.items()], quantized(vector, scale).alias("x"), F.monotonically_increasing_id().alias("rid"))
    stored = buckets.write(whole.repartition(buckets.number, "rid"), "vectors")
    vectors = stored.select("rid", "x")

    state = buckets.write(_scanned(vectors.withColumn("was", F.lit(None).cast("int")), centroids), "bounds")
    counts, sums = [0] * len(centroids), [[0] * size for _ in centroids]
    for i in range(rounds):
        if seen:
            seen(state, i)
        for r in _moves(state, vectors):
            counts[r["k"]] += r["n"] if r["i"] == 0 else 0
            sums[r["k"]][r["i"]] += int(r["s"])
        old, centroids = centroids, [[s // n for s in total] if n else c for c, n, total in zip(centroids, counts, sums, strict=True)]
        after = buckets.write(_next(state, vectors, old, centroids), "bounds")
        buckets.drop(state)
        state = after
    measured = buckets.write(_measured(state.join(vectors.hint("merge"), "rid"), centroids), "distances")
    total = {r["cluster"]: min(int(r["s"]), LARGEST) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    buckets.drop(state)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return stored.drop("x").join(measured.hint("merge"), "rid").select(
        *[F.col(n).alias(c) for c, n in aside.items()], "cluster", "distance", of([total.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(min(sum(total.values()), LARGEST)).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"),
    )
