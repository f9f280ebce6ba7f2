"""The store's tables as files: whole tables, deltas of the rows that changed, and commits that name them.

A commit names the files of all tables, so what several tables get at once counts together, or, if the writer stops before, not at all. A
table is its base with its deltas in order; a delta holds changed rows whole, or the keys of rows that went. Readers put a delta's rows in place of the base's: the base is
joined with the deltas' keys, which are few, and isn't shuffled for it where Spark can broadcast them. The ledger only grows: it is its
deltas. When an entity is read, that is noted as a row of its own (touches), not by writing the entity. FAN deltas of one level are
merged into one of the next, so a table of n small writes is read from some FAN * log(n) files; files that no kept commit
names are deleted then.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tessera.schema import TABLES, empty, migrate
from tessera.sources import commits as C

#: Tables that only grow.
APPENDED = {"events", "touches"}
KEYS = {"entities": ["id"], "tags": ["id"], "entity_tags": ["entity_id", "tag_id"], "relations": ["id"], "embeddings": ["entity_id"], "locks": ["task_name"]}
#: Deltas of a level that are merged into one of the next; commits that stay readable.
FAN, KEPT = 16, 32


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; what was to be written was derived from an older state."""


def _log(spark: SparkSession, root: str) -> C.Commits:
    return C.Commits(spark, f"{root}/commits")


def versions(spark: SparkSession, root: str) -> list[int]:
    return _log(spark, root).numbers()


def state(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last commit's number and all that it keeps."""
    return _log(spark, root).last()


def _with_gone(name: str) -> StructType:
    return StructType([*TABLES[name].fields, StructField("gone", BooleanType())])


def _base(spark: SparkSession, root: str, name: str, path: str | None) -> DataFrame:
    # With the schema given, columns that an older file lacks are null, and a file without rows can be read.
    return migrate(spark.read.schema(TABLES[name]).parquet(f"{root}/{path}"), name) if path else empty(spark, name)


def _latest(spark: SparkSession, root: str, name: str, deltas: list[str]) -> DataFrame:
    """The deltas' rows, each key's last, with whether it is gone."""
    schema, keys = _with_gone(name), KEYS[name]
    parts = [spark.read.schema(schema).parquet(f"{root}/{p}").withColumn("nth", F.lit(i)) for i, p in enumerate(deltas)]
    if len(parts) == 1:
        return parts[0].drop("nth")
    rest = [c for c in schema.names if c not in keys]
    last = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.max_by(F.struct(*rest), "nth").alias("x"))
    return last.select(*keys, "x.*").select(*schema.names)


def _resolved(spark: SparkSession, root: str, name: str, files: dict) -> DataFrame:
    base, deltas = _base(spark, root, name, files.get("base")), [p for p, _ in files.get("deltas", [])]
    if not deltas:
        return base
    if name in APPENDED:
        added = migrate(spark.read.schema(TABLES[name]).parquet(*[f"{root}/{p}" for p in deltas]), name)
        return base.unionByName(added) if files.get("base") else added
    latest = _latest(spark, root, name, deltas)
    live = latest.where(~F.coalesce("gone", F.lit(False))).drop("gone")
    return base.join(latest.select(*KEYS[name]), KEYS[name], "left_anti").select(*live.columns).unionByName(live) if files.get("base") else live


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as the last commit has it, or a given one that is kept."""
    tables = _log(spark, root).last(version)[1].get("tables", {})
    out = _resolved(spark, root, name, tables.get(name, {}))
    if name == "entities" and tables.get("touches"):
        seen = _resolved(spark, root, "touches", tables["touches"]).groupBy(F.col("id").alias("seen_id")).agg(F.max("last_accessed_at").alias("seen_at"))
        out = out.join(seen, F.col("id") == F.col("seen_id"), "left").withColumn("last_accessed_at", F.greatest("last_accessed_at", "seen_at")).drop("seen_id", "seen_at")
    return out


def _put(df: DataFrame, root: str, name: str, by: str | None = None, suffix: str = "") -> str:
    path = f"data/{name}{suffix}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(f"{root}/{path}")
    return path


def commit(
    spark: SparkSession, root: str, replaced: dict[str, DataFrame] | None = None, changed: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, since: int | None = None, extra: dict | None = None
) -> int:
    """Writes whole tables, changed rows, keys of rows that went, and rows of tables that only grow; then one commit makes them all count. Its number.

    since: the commit that the rows were derived from, the last one if not given; if there has been another since, Conflict.
    Rows of tables that only grow never conflict. extra: what else the commit keeps, by name; it stays until it is replaced.
    """
    log, schema = _log(spark, root), _with_gone
    number, _ = log.last()
    since = number if since is None else since
    # Entities are in folders by status, so active rows are read alone.
    whole = {n: _put(migrate(df, n), root, n, "status" if n == "entities" else None) for n, df in (replaced or {}).items()}
    new = {n: [_put(migrate(df, n).withColumn("gone", F.lit(False)), root, n)] for n, df in (changed or {}).items()}
    for n, df in (gone or {}).items():
        keys = df.select(*KEYS[n])
        new.setdefault(n, []).append(_put(keys.select(*[(F.col(f.name) if f.name in KEYS[n] else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[n].fields], F.lit(True).alias("gone")).select(*schema(n).names), root, n))
    grown = {n: [_put(migrate(df, n), root, n)] for n, df in (added or {}).items()}
    while True:
        number, state = log.last()
        if number != since and (whole or new or extra):
            raise Conflict(f"commit {number} came after {since}")
        tables = {n: {"base": f.get("base"), "deltas": list(f.get("deltas", []))} for n, f in state.get("tables", {}).items()}
        tables |= {n: {"base": p, "deltas": []} for n, p in whole.items()}
        for n, paths in (new | grown).items():
            tables.setdefault(n, {"base": None, "deltas": []})["deltas"] += [[p, 0] for p in paths]
        if log.commit(number + 1, state | {"tables": tables} | (extra or {})):
            if whole or _merged(spark, root):
                vacuum(spark, root)
            return number + 1


def _run(deltas: list) -> int:
    """How many deltas at the end are of one level, if there are FAN."""
    n = 0
    while n < len(deltas) and deltas[-1 - n][1] == deltas[-1][1]:
        n += 1
    return n if n >= FAN else 0


def _merged(spark: SparkSession, root: str) -> bool:
    """Whether deltas were merged: the last of one level, by a commit of its own, and again while there are enough of the next. Merged files have
    a folder of their own, so a stream over the ledger's files sees each event once."""
    done = False
    while True:
        number, state = _log(spark, root).last()
        name, files = next(((n, f) for n, f in state["tables"].items() if _run(f["deltas"])), (None, None))
        if name is None:
            return done
        n, level = _run(files["deltas"]), files["deltas"][-1][1]
        last = [p for p, _ in files["deltas"][-n:]]
        rows = spark.read.schema(TABLES[name]).parquet(*[f"{root}/{p}" for p in last]) if name in APPENDED else _latest(spark, root, name, last)
        path = _put(rows.coalesce(max(1, rows.rdd.getNumPartitions() // FAN)), root, name, suffix="-merged")
        after = {"base": files.get("base"), "deltas": [*files["deltas"][:-n], [path, level + 1]]}
        if not _log(spark, root).commit(number + 1, state | {"tables": state["tables"] | {name: after}}):
            C.delete(spark, f"{root}/{path}")  # another writer was faster; its next commit merges
            return done
        done = True


def compact(spark: SparkSession, root: str) -> int:
    """Every table as one base; what is read stays the same."""
    number, state = _log(spark, root).last()
    tables = state.get("tables", {})
    whole = {n: read(spark, root, n, number) for n in tables if n not in APPENDED}
    out = commit(spark, root, replaced=whole, since=number)
    return out


def vacuum(spark: SparkSession, root: str, kept: int = KEPT) -> None:
    """Deletes the files that none of the last commits names, and the older commits."""
    log = _log(spark, root)
    numbers = log.numbers()
    states = {n: log.last(n)[1] for n in numbers}

    def paths(state: dict) -> set[str]:
        files = {p for f in state.get("tables", {}).values() for p in [f.get("base"), *[d for d, _ in f.get("deltas", [])]] if p}
        return files | {f"{index}/{kind}/s={n}" for index, held in state.get("indexes", {}).items() for n in held.get("segments", []) for kind in ("postings", "docs")}

    live = set().union(*[paths(states[n]) for n in numbers[-kept:]])
    for path in set().union(*[paths(states[n]) for n in numbers[:-kept]]) - live:
        C.delete(spark, f"{root}/{path}")
    log.forget(numbers[-kept] if len(numbers) > kept else 0)


def write(df: DataFrame, root: str, name: str) -> int:
    """Writes a table whole, or appends to one that only grows. The commit's number."""
    return commit(df.sparkSession, root, added={name: df}) if name in APPENDED else commit(df.sparkSession, root, replaced={name: df})


def changes(before: DataFrame, after: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(changed, gone): rows of after that aren't in before as they are, and keys of before that after lacks.

    One side's rows are compared with the other's by a hash of the row, joined by key.
    """
    keys, print_ = KEYS[name], F.xxhash64(*TABLES[name].names)
    mark = lambda df, out: df.select(*[F.col(k).alias(f"{out}_{k}") for k in keys], print_.alias(out))
    same: Column = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"old_{k}") for k in keys])
    changed = after.withColumn("new", print_).join(mark(before, "old"), same & (F.col("new") == F.col("old")), "left_anti").drop("new")
    gone = before.select(*keys).join(after.select(*keys), keys, "left_anti")
    return changed, gone


def size(spark: SparkSession, root: str) -> dict[str, int]:
    """Bytes of each table's files as the last commit names them, from the file system's metadata."""
    tables = _log(spark, root).last()[1].get("tables", {})
    return {n: sum(C.size(spark, f"{root}/{p}") for p in [f.get("base"), *[d for d, _ in f.get("deltas", [])]] if p) for n, f in tables.items()}


def backup(spark: SparkSession, root: str, to: str) -> str:
    """Copies the tables as they are now, under a name that tells the time."""
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    number, state = _log(spark, root).last()
    tables = {n: read(spark, root, n, number) for n in state.get("tables", {}) if n != "touches"}
    commit(spark, f"{to}/{stamp}", replaced={n: df for n, df in tables.items() if n not in APPENDED}, added={n: df for n, df in tables.items() if n in APPENDED})
    return f"{to}/{stamp}"
