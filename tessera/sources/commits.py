"""Numbered commits and exclusive folders, on the file system that holds the store.

One writer alone can make a folder: it is filled beside its place and renamed, and whoever finds its own token there has won. That holds where
renaming onto a folder fails and where it moves the folder into the other one, so for local and distributed file systems alike.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def get(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None if there is no such file."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    try:
        stream = fs.open(p)
    except Py4JJavaError:  # it went meanwhile
        return None
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under the path, from the file system's metadata."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def move(spark: SparkSession, path: str, to: str) -> bool:
    fs, p = _at(spark, path)
    try:
        return fs.rename(p, _at(spark, to)[1])
    except Py4JJavaError:  # another writer moved it first
        return False


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the folder, with the text as its file `said`; False if another writer made it before."""
    token = uuid.uuid4().hex
    beside = f"{path}.new-{token}"
    put(spark, f"{beside}/said", text)
    put(spark, f"{beside}/token", token)
    if names(spark, path) == []:
        move(spark, beside, path)
    if get(spark, f"{path}/token") == token:
        return True
    delete(spark, beside)
    delete(spark, f"{path}/{beside.rsplit('/', 1)[-1]}")
    return False


class Commits:
    """The states of something, numbered, each whole: the last one counts. What a state names is written before it is committed, so a writer
    that stops halfway leaves the last state as it was."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        return [int(n) for n in names(self.spark, self.folder) if n.isdigit()]

    def last(self, number: int | None = None) -> tuple[int, dict]:
        """The number and state of the last commit, or of the one given; 0 and nothing before the first."""
        at = max(self.numbers(), default=0) if number is None else number
        return at, json.loads(get(self.spark, f"{self.folder}/{at:012d}/said")) if at else {}

    def commit(self, number: int, state: dict) -> bool:
        """False if another writer has committed this number."""
        return claim(self.spark, f"{self.folder}/{number:012d}", json.dumps(state))

    def forget(self, before: int) -> None:
        """Old states can't be read any more."""
        for n in self.numbers():
            if n < before:
                delete(self.spark, f"{self.folder}/{n:012d}")
