"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

#: Used only where spark.checkpoint.dir is unset, as in local tests.
LOCAL_SCRATCH = "/tmp/checkpoints"

#: Rows of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or LOCAL_SCRATCH
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to the given ones that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, inputs: Sequence[str], outputs: Sequence[tuple[str, DataType]], make: Callable[[], Callable[[list], list[tuple]]]) -> DataFrame:
    """Appends columns computed row by row in Python from some columns.

    make() runs once a task and returns a function from rows (tuples of the inputs, SLICE_ROWS at most) to
    tuples of the outputs. Columns of df that bear an output's name are replaced.
    """
    new = {n.lower() for n, _ in outputs}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    args = fresh(df, *[f"arg{i}" for i in range(len(inputs))])
    sent = df.select(*[F.col(f"`{f.name}`") for f in keep], *[F.col(f"`{c}`").alias(a) for c, a in zip(inputs, args, strict=True)])
    schema = StructType([*keep, *[StructField(n, t) for n, t in outputs]])
    arrow, n_keep = to_arrow_schema(schema), len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = list(zip(*[part.column(n_keep + i).to_pylist() for i in range(len(inputs))], strict=True))
                cols = list(zip(*work(rows), strict=True))
                made = [pa.array(c, type=arrow.field(n_keep + i).type) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(arrow.field(i).type) for i in range(n_keep)], *made], schema=arrow)

    return sent.mapInArrow(run, schema)


def gapless_index(df: DataFrame, groups: Sequence[str], salt: Column, order: Sequence[str], out: str) -> DataFrame:
    """Appends to each row its place, from 0 and without gaps, within its group.

    A group of any size is dealt over the values of salt: places are counted within each (group, salt) and
    shifted by the sizes of the salts before it, so no task holds a whole group. df is read twice.
    """
    s, n, before, place = fresh(df, "salt", "cell_rows", "rows_before", "place_in_cell")
    df = df.withColumn(s, salt)
    cell = [*groups, s]
    sizes = df.groupBy(*cell).agg(F.count(F.lit(1)).alias(n))
    ahead = Window.partitionBy(*groups).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*cell, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before))
    placed = df.withColumn(place, F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1)
    right = starts.select(*[F.col(c).alias(f"{c}__r") for c in cell], before)
    same = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in cell]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    return placed.join(right, cond).withColumn(out, F.col(place) + F.col(before)).drop(s, before, place, *[f"{c}__r" for c in cell])


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table whose successor is written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
