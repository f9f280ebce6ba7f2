"""Embedding columns: a pluggable embedder in Arrow batches, and a deterministic hashing embedder for tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.functions.porter import fts_tokens
from tessera.session import written

#: Texts that are embedded at a time.
SLICE_ROWS = 256
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(size: int = 384) -> Embedder:
    """Signed counts of hashed tokens, of unit norm; a text without tokens is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in fts_tokens(text):
                h = zlib.crc32(token.encode())
                row[h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(texts: Column, make: Callable[[], Embedder] = hashing_embedder) -> Column:
    """The embedding of each text. make() runs once a task, where a model is loaded."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for batch in batches:
            yield pd.Series(list(embedder(batch.fillna("").tolist())))

    return run(texts)


def _tried(embedder: Embedder, texts: list[str]) -> list[tuple]:
    """(vector, error) of each text: a batch that fails is halved until the text that makes it fail is alone."""
    try:
        return [(v, None) for v in embedder(texts)]
    except Exception as e:  # noqa: BLE001  whatever a model raises is that text's failure
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return _tried(embedder, texts[:half]) + _tried(embedder, texts[half:])


def embed_or_fail(texts: Column, make: Callable[[], Embedder] = hashing_embedder) -> Column:
    """(embedding, error) of each text, one of them null."""

    kind = pa.struct([("embedding", pa.list_(pa.float32())), ("error", pa.string())])

    @F.arrow_udf("embedding array<float>, error string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make()
        for batch in batches:
            # Only a slice's texts and vectors are Python objects at a time; Arrow holds the batch's others.
            slices = ([t or "" for t in batch.slice(at, SLICE_ROWS).to_pylist()] for at in range(0, len(batch), SLICE_ROWS))
            made = [pa.array([{"embedding": v, "error": e} for v, e in _tried(embedder, some)], kind) for some in slices]
            yield pa.concat_arrays(made) if made else pa.array([], kind)

    return run(texts)


def pending(retry: bool = False) -> Column:
    """Rows that still need an embedding; retry: those that failed too."""
    return (F.col("status") != "archived") & F.coalesce(F.col("embedding_status"), F.lit("")).isin("", "pending", *(["failed"] if retry else []))


def backfill(entities: DataFrame, embeddings: DataFrame, make: Callable[[], Embedder] = hashing_embedder, retry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, embeddings) with vectors of title and content for the pending rows, which then are ready, or failed where the embedder did."""
    tried = entities.where(pending(retry)).select(F.col("id").alias("entity_id"), embed_or_fail(F.concat_ws("\n\n", "title", "full_content"), make).alias("e"))
    tried = written(tried.select("entity_id", "e.embedding", "e.error"), "embedded")  # the embedder runs once
    due, failed = tried.where("error is null").select("entity_id", "embedding"), tried.where("error is not null").select("entity_id")
    kept = embeddings.join(due.select("entity_id"), "entity_id", "left_anti")
    status = F.when(F.col("failed_id").isNotNull(), "failed").when(pending(retry), "ready").otherwise(F.col("embedding_status"))
    after = entities.join(failed.withColumnRenamed("entity_id", "failed_id"), F.col("id") == F.col("failed_id"), "left").withColumn("embedding_status", status).drop("failed_id")
    return after, kept.unionByName(due)
