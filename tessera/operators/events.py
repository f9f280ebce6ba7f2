"""The event ledger: appending, recent events, sessions, live status of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.redact import redact

REQUEST = "consolidation_request"
MOST_CHARS = 1000


def event(requests: DataFrame, now: Column, rules: list[str] | None = None) -> DataFrame:
    """Rows to append: an id that depends on the content, and the content redacted. Columns lacking in requests take their defaults."""
    have = set(requests.columns)
    default = {"agent_id": F.lit("system"), "type": F.lit("event"), "content": F.lit("")}
    c = {k: F.coalesce(F.col(k), default.get(k, F.lit(None))) if k in have else default.get(k, F.lit(None)) for k in ("agent_id", "type", "content", "error_code", "session_id", "context_id")}
    seq = F.col("seq") if "seq" in have else F.monotonically_increasing_id()
    uid = F.sha2(F.concat_ws("|", seq.cast("string"), now.cast("string"), *[F.coalesce(x.cast("string"), F.lit("")) for x in c.values()]), 256)
    return requests.select(uid.alias("id"), now.alias("timestamp"), *[(redact(x, rules) if k == "content" else x).cast("string").alias(k) for k, x in c.items()])


def shortened(content: Column, kind: Column) -> Column:
    """Long contents cut, but for requests."""
    return F.when((kind != REQUEST) & (F.length(content) > MOST_CHARS), F.concat(F.substring(content, 1, MOST_CHARS), F.lit(" [TRUNCATED]"))).otherwise(content)


def recent(events: DataFrame, agent_id: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
    out = events
    if agent_id is not None:
        out = out.where(F.col("agent_id") == agent_id)
    if kind is not None:
        out = out.where(F.col("type") == kind)
    return out.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).withColumn("content", shortened(F.col("content"), F.col("type")))


def with_request_status(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """rows with the column status: that of requests, null for other events. For pages of events."""
    status = request_status(rows.where(F.col("type") == REQUEST), entities).select(F.col("id").alias("of"), "status")
    return rows.join(status, F.col("id") == F.col("of"), "left").drop("of")


def session(events: DataFrame, session_id: str) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy("timestamp", "id")


def request_status(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, status) of requests: pending while any of their entity_ids is raw, and where the content isn't JSON; else resolved."""
    body = F.get_json_object("content", "$.entity_ids")
    parsed = requests.select("id", F.get_json_object("content", "$").isNull().alias("bad"), F.from_json(body, "array<string>").alias("ids"))
    each = parsed.select("id", "bad", F.explode_outer("ids").alias("entity"))
    raw = entities.where("status = 'raw'").select(F.col("id").alias("entity"), F.lit(1).alias("raw"))
    open_ = each.join(raw, "entity", "left").groupBy("id").agg(F.max("bad").alias("bad"), F.count("raw").alias("n"))
    return open_.select("id", F.when(F.col("bad") | (F.col("n") > 0), "pending").otherwise("resolved").alias("status"))
