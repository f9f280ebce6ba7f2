"""Structured Streaming over the ledger: deduplicated appends, sessions by gaps, windowed counts."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.events import REQUEST
from tessera.schema import TABLES

if TYPE_CHECKING:
    from tessera.plans.service import Store


def read_ledger(spark: SparkSession, root: str, late: str = "1 hour") -> DataFrame:
    """The events of the store at root as they are logged, each id once within the watermark. A stream that rests longer than the store keeps files
    (KEPT commits) misses none of the table, but those of merged files: it then begins from the table anew."""
    return spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "*.parquet").parquet(f"{root}/data/events/*").withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("timestamp", gap).alias("w"), "agent_id").agg(F.count(F.lit(1)).alias("n")).select("agent_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def type_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("timestamp", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def trigger_librarian(store: Store, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Runs the store's librarian when its ledger grows, by the store's own rules (enough raw entities, the cooldown, the lock). The librarian's own
    requests trigger nothing. Each batch counts once, also when it is replayed after a failure; events of batches that came too soon wait for the next."""
    new = read_ledger(store.spark, store.root, late).where(F.col("type") != REQUEST)

    def run(batch: DataFrame, number: int) -> None:
        store.triggered(checkpoint, number, batch.count())

    return new.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends results as they become final; ends when the input that is there now is done."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
