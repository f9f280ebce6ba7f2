"""Schemas of the store's tables, empty frames and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType, TimestampType

S, T, I = StringType(), TimestampType(), IntegerType()  # noqa: E741


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


TABLES: dict[str, StructType] = {
    "entities": _struct(
        id=S, created_at=T, updated_at=T, last_accessed_at=T, owner_id=S, scope=S, is_core=BooleanType(), weight=I, status=S, parent_ids=ArrayType(S), title=S, full_content=S, valid_from=T, valid_to=T,
        metadata=S, project_id=S, context_id=S, embedding_status=S, content_hash=S, quality_score=DoubleType(), quality_status=S, quality_flags=ArrayType(S),
    ),
    "events": _struct(id=S, timestamp=T, agent_id=S, type=S, content=S, error_code=S, session_id=S, context_id=S),
    "tags": _struct(id=S, name=S, canonical_id=S, created_at=T),
    "entity_tags": _struct(entity_id=S, tag_id=S),
    "relations": _struct(id=S, source_id=S, target_id=S, predicate=S, created_at=T, valid_from=T, valid_to=T),
    "embeddings": _struct(entity_id=S, embedding=ArrayType(FloatType())),
    "touches": _struct(id=S, last_accessed_at=T),
    "locks": _struct(task_name=S, locked_at=T, locked_by=S, last_run_at=T),
}

SCOPES, STATUSES = ("private", "shared"), ("raw", "consolidated", "archived")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def migrate(df: DataFrame, name: str) -> DataFrame:
    """df with all columns of the current schema, those it lacks null; columns that the schema lacks are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
