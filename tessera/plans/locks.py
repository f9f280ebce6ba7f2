"""The batch jobs' lock on the store's file system, its listing, and the process-local key-value store."""

from __future__ import annotations

import datetime as dt
import json
import os
import socket
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.schema import TABLES
from tessera.sources import commits as C

STALE_S = 600


class JobLock:
    """A folder that one of any number of sessions can make. A lock that is older than STALE_S counts as left behind: it is moved away by
    whoever finds it, which only one can do, and then claimed anew. Only its owner releases a lock."""

    def __init__(self, spark: SparkSession, folder: str, task: str = "librarian_consolidation"):
        self.spark, self.folder, self.task, self.owner = spark, folder, task, f"{socket.gethostname()}-{os.getpid()}-{uuid.uuid4().hex}"
        self.path, self.last = f"{folder}/{task}.lock", f"{folder}/{task}.last"

    def _held(self) -> dict | None:
        said = C.get(self.spark, f"{self.path}/said")
        return json.loads(said) if said else None

    def acquire(self, now: float | None = None) -> bool:
        now = time.time() if now is None else now
        held = self._held()
        if held and now - held["locked_at"] > STALE_S:
            aside = f"{self.path}.stale-{uuid.uuid4().hex}"
            if C.move(self.spark, self.path, aside):
                moved = json.loads(C.get(self.spark, f"{aside}/said") or "null")
                if moved != held:  # another session took it over in between: its lock goes back
                    C.move(self.spark, aside, self.path)
                    return False
                C.delete(self.spark, aside)
        return C.claim(self.spark, self.path, json.dumps({"locked_at": now, "locked_by": self.owner}))

    def release(self, now: float | None = None) -> bool:
        """False if the lock isn't this owner's any more."""
        held = self._held()
        if not held or held["locked_by"] != self.owner:
            return False
        C.delete(self.spark, self.last)
        C.put(self.spark, self.last, str(time.time() if now is None else now))
        C.delete(self.spark, self.path)
        return True

    def seconds_since_last(self, now: float | None = None) -> float | None:
        last = C.get(self.spark, self.last)
        return (time.time() if now is None else now) - float(last) if last else None


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(task_name, locked_at, locked_by, last_run_at) of all tasks that hold a lock or have run: a few small files."""
    at = lambda t: None if t is None else dt.datetime.fromtimestamp(float(t))
    tasks = sorted({n.rsplit(".", 1)[0] for n in C.names(spark, folder) if n.endswith((".lock", ".last"))})
    rows = []
    for task in tasks:
        held = json.loads(C.get(spark, f"{folder}/{task}.lock/said") or "{}")
        rows.append((task, at(held.get("locked_at")), held.get("locked_by"), at(C.get(spark, f"{folder}/{task}.last"))))
    return spark.createDataFrame(rows, TABLES["locks"])


class Ephemeral:
    """Keys and values that end with the process; both are needed to store."""

    def __init__(self) -> None:
        self._held: dict[str, str] = {}

    def put(self, key: str | None, value: str | None) -> None:
        if not key or value is None:
            raise ValueError("key and value are needed")
        self._held[key] = value

    def get(self, key: str) -> str | None:
        return self._held.get(key)
