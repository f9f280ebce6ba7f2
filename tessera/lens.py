"""The driver's tables seen as the store's: how its documents, labels and events map onto entities, tags, relations and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.session import spread

START = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n: str):
    return F.expr(f"timestamp'{START}' + make_dt_interval(0, 0, cast({n} as int), 0)")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    vec = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v")).distinct()
    status = F.when(d % 10 == 9, "archived").when(d % 10 == 8, "consolidated").otherwise("raw")
    out = read(spark, sf_dir, "documents").join(vec, d == F.col("v"), "left").select(
        d.cast("string").alias("id"), "doc_id", F.col("source").alias("owner_id"), F.col("lang").alias("context_id"), F.lit(None).cast("string").alias("project_id"), F.col("text").alias("full_content"),
        F.when(d % 5 == 0, "private").otherwise("shared").alias("scope"), (d % 50 == 0).alias("is_core"), (1 + d % 5).cast("int").alias("weight"), status.alias("status"),
        _minutes("doc_id").alias("created_at"), _minutes("(doc_id * 7) % 1000").alias("updated_at"),
        F.when(d % 10 == 9, "archived").when(F.col("v").isNotNull(), "ready").otherwise("pending").alias("embedding_status"),
        F.concat(F.lit("doc "), d.cast("string")).alias("title"),
        F.when(status == "consolidated", F.array((d - 1).cast("string"), (d - 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parent_ids"),
    )
    return out


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#<lang>, #<source>, #toxic, #lowq and two more spellings of #src0; the id is the name."""
    docs = read(spark, sf_dir, "documents")
    names = docs.select(F.concat(F.lit("#"), "lang").alias("name")).union(docs.select(F.concat(F.lit("#"), "source"))).distinct()
    more = spark.createDataFrame([("#toxic",), ("#lowq",), ("#Src_0",), ("#src-0",)], "name string")
    return names.union(more).select(F.col("name").alias("id"), "name", F.lit(None).cast("string").alias("canonical_id"), F.when(F.col("name").isin("#Src_0", "#src-0"), F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp").alias("created_at"))


def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    i = F.col("doc_id").cast("string").alias("entity_id")
    out = docs.select(i, F.concat(F.lit("#"), "lang").alias("tag_id")).union(docs.select(i, F.concat(F.lit("#"), "source")))
    out = out.union(labels.where("toxic = 1").select(i, F.lit("#toxic"))).union(labels.where("quality = 0").select(i, F.lit("#lowq")))
    return out.union(docs.where("doc_id % 40 = 0").select(i, F.lit("#Src_0"))).union(docs.where("doc_id % 40 = 1").select(i, F.lit("#src-0"))).distinct()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    d = F.col("doc_id")
    a = docs.where("doc_id >= 1 and doc_id % 7 <> 0").select(d, F.expr("doc_id div 2").alias("t"), F.lit("derived_from").alias("predicate"), F.when(d % 11 == 0, F.lit("2024-01-02").cast("timestamp")).alias("valid_to"))
    b = docs.where("doc_id % 30 = 0").join(F.broadcast(n)).select(d, F.expr("(doc_id * 7 + 3) % n").alias("t"), F.lit("links_to").alias("predicate"), F.lit(None).cast("timestamp").alias("valid_to")).where("doc_id <> t")
    both = a.unionByName(b)
    s, t = d.cast("string"), F.col("t").cast("string")
    return both.select(F.concat_ws(">", s, "predicate", t).alias("id"), s.alias("source_id"), t.alias("target_id"), "predicate", _minutes("doc_id").alias("created_at"), F.lit(START).cast("timestamp").alias("valid_from"), "valid_to")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("agent_id"), F.col("event_type").alias("type"), F.col("props").alias("content"), F.concat_ws("-", F.col("user_id").cast("string"), day).alias("session_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tokens): sorted sets of words of three letters or more, in lower case."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("id"), X.word_set(F.lower("text")).alias("tokens"))
