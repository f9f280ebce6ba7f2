"""Sessions and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    base = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=base | conf).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: in spark.checkpoint.dir, or, on one machine alone, in LOCAL_CHECKPOINTS."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or LOCAL_CHECKPOINTS).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that the cluster names in spark.checkpoint.dir."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again. For loops: unlike a checkpoint it keeps no constraints, which grow with each round."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all cores, for measures that cost much more than moving the rows; by: columns that tell rows apart.

    Only a table with fewer partitions than there are cores is shuffled, so what moves is bounded by the cores times
    spark.sql.files.maxPartitionBytes or a Parquet row group; a larger table is read where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *by) if df.rdd.getNumPartitions() < cores else df
