"""A commit log: numbered JSON documents in a folder of any store that Spark reads, each put there once.

A writer reads the log, decides, and commits the next number.  If another writer was first, the commit is lost and the
writer decides again on what is there now.  Data that a commit speaks of is written before, below the same folder, so
that a reader sees all of a commit or nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, store = _store(spark, path)
    return store.exists(hadoop)


def _written(spark: SparkSession, path: str, text: str):
    """A whole file of another name beside path."""
    folder, _, name = path.rpartition("/")
    hadoop, store = _store(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    out = store.create(hadoop, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return hadoop, store


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file unless there is one: whole, and by one of any number of writers (True for that one).

    On a local disk a hard link decides, elsewhere the store's rename that doesn't overwrite."""
    beside, store = _written(spark, path, text)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if store.getScheme() == "file":
            try:
                os.link(*(unquote(urlparse(store.makeQualified(p).toString()).path) for p in (beside, target)))
            except FileExistsError:
                return False
            return True
        fs = spark._jvm.org.apache.hadoop.fs
        never = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        never[0] = getattr(fs, "Options$Rename").NONE
        try:
            fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, never)
        except Exception as x:
            if "FileAlreadyExists" in str(x):
                return False
            raise
        return True
    finally:
        store.delete(beside, False)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file, whole; one that is there gives way."""
    beside, store = _written(spark, path, text)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not store.rename(beside, target):  # stores whose rename doesn't overwrite
        store.delete(target, False)
        if not store.rename(beside, target):
            raise OSError(f"can't write {path}")


def read(spark: SparkSession, path: str) -> str:
    hadoop, store = _store(spark, path)
    size = store.getFileStatus(hadoop).getLen()
    stream = store.open(hadoop)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    finally:
        stream.close()


class Log:
    """The commits 0, 1, ... of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/commits/{number:012d}.json"

    def length(self) -> int:
        """How many commits there are; their numbers have no gaps."""
        folder, store = _store(self.spark, f"{self.folder}/commits")
        if not store.exists(folder):
            return 0
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return sum(1 for n in names if n.endswith(".json") and n[0] not in "._")

    def entries(self) -> list[dict]:
        """All commits, in order: small documents, however much data they speak of."""
        return [json.loads(read(self.spark, self._path(k))) for k in range(self.length())]

    def put(self, number: int, entry: dict) -> bool:
        return put_new(self.spark, self._path(number), json.dumps(entry, sort_keys=True, ensure_ascii=False))

    def commit(self, decide: Callable[[list[dict]], dict | None]) -> int:
        """Commits what decide makes of the commits so far, again and again until no other writer is first; None leaves
        the log as it is.  Returns the number of commits."""
        while True:
            now = self.entries()
            entry = decide(now)
            if entry is None:
                return len(now)
            if self.put(len(now), entry):
                return len(now) + 1
