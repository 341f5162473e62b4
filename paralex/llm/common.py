"""Shared parts of the training-data operators.

Two ideas carry most of them.

*Vectorised text.*  A batch of texts is one byte buffer with offsets.  Words, lines and n-grams are found with NumPy
over that buffer, and a run of bytes is hashed from prefix sums of a polynomial modulo 2**64, so no Python code runs per
word.

*Requests and answers.*  A question about the whole corpus ("does this window occur earlier?", "how many documents hold
this shingle?") is asked by groups of documents.  Each group asks about every distinct item once, packed into one binary
row per bucket of the item's hash; each bucket answers with one row per group.  A key that a third of all rows share is
thus asked for once per group, whatever its frequency, and no bucket ever holds a row per occurrence.  Both groups and
buckets grow with the corpus, so that each fits in memory; a group sends no row to a bucket that it asks nothing of, so
there never are more rows than distinct items of groups, which is what a shuffle of single items would send.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that one NumPy pass takes at most; a longer document is a pass of its own.
PASS_BYTES = 1 << 20
#: Bytes of (compressed) input that one group of documents takes, about.
GROUP_BYTES = 4 << 20
#: The same where a group also holds an array entry, or several, for each of its words.
SMALL_GROUP_BYTES = 2 << 20
_MULT = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


# ---------------------------------------------------------------- Spark side


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local one stands in,
    which only a local master (tests) can share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(where)
    return where


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage is cut and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for jobs of wide rows that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def group_count(df: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """Groups of about group_bytes of input each, by the size that the plan's statistics give; at least one a shuffle
    partition (two, of small groups).  A plan without statistics (an RDD behind it) gets the least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = shuffle_partitions(df.sparkSession) * GROUP_BYTES // group_bytes
    return max(least, size // group_bytes) if size < 1 << 55 else least


def group_of(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def dealt(groups: int) -> Column:
    """The group of a row (doc_id, text): rows of one doc_id go together, those without one by their text."""
    return group_of(F.coalesce(F.col("doc_id"), F.xxhash64("text")), groups)


def give_back() -> None:
    """Freed memory goes back to the system: a worker waits for its next task no larger than it began."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- bytes


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def pack_rising(x: np.ndarray) -> bytes:
    """A sorted array of unsigned integers, by differences in byte planes."""
    d = np.diff(x.astype(U), prepend=U(0))
    return squeeze(d.view(np.uint8).reshape(-1, 8).T)


def unpack_rising(x: bytes) -> np.ndarray:
    planes = unsqueeze(x, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(U), dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit moves every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_MULT, _INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Rabin-Karp: the hash of values[s:e] for each (s, e), from prefix sums; equal runs have equal hashes.

    salt: another value gives another hash, of values that are themselves hashes.
    """
    up, down = powers(len(values) + 1)
    if salt:
        values = mix(values + U(salt))
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * up[: len(values)], out=total[1:], dtype=U)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Texts:
    """Rows [lo, hi) of a text column as one byte buffer with offsets; null is empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.fill_null("") if column.null_count else column
        offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.at = offsets - offsets[0]
        if lower:
            self.data = LOWER[self.data]

    def _begin(self) -> np.ndarray:
        begin = np.zeros(len(self.data) + 1, bool)
        begin[self.at] = True
        return begin

    def _found(self, starts: np.ndarray, ends: np.ndarray) -> None:
        self.starts, self.ends = starts, ends
        self.doc = np.searchsorted(self.at, starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(self.at)))

    def words(self) -> Texts:
        """Sets starts, ends (bytes), doc of each word, and first: the number of words before each document."""
        inside, begin = ~SPACE[self.data], self._begin()
        fresh = np.ones(len(inside) + 1, bool)
        fresh[1:] = ~inside
        starts = np.flatnonzero(inside & (fresh[:-1] | begin[:-1]))
        over = begin.copy()
        over[:-1] |= ~inside
        over[-1] = True
        ends = np.flatnonzero(inside & over[1:]) + 1
        self._found(starts, ends)
        return self

    def lines(self) -> Texts:
        """As words(), for the pieces between line feeds; each document has one more than it has line feeds."""
        n = len(self.at) - 1
        feeds = np.flatnonzero(self.data == 10)
        doc = np.searchsorted(self.at, feeds, "right") - 1
        order = np.argsort(np.concatenate([np.arange(n) * 2, doc * 2 + 1]), kind="stable")
        starts = np.concatenate([self.at[:-1], feeds + 1])[order]
        order = np.argsort(np.concatenate([doc * 2, np.arange(n) * 2 + 1]), kind="stable")
        ends = np.concatenate([feeds, self.at[1:]])[order]
        self.starts, self.ends = starts, ends
        self.doc = np.repeat(np.arange(n), np.bincount(doc, minlength=n) + 1)
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        return self

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data.astype(U) + U(1), self.starts, self.ends)

    def joined(self, keep: np.ndarray, by: int = 32) -> pa.Array:
        """Each document's kept pieces, joined by one byte."""
        s, e, doc = self.starts[keep], self.ends[keep], self.doc[keep]
        size = e - s + 1
        to = np.zeros(len(s) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        pick = np.repeat(s - to[:-1], size) + np.arange(to[-1])
        out = np.append(self.data, np.uint8(by))[pick]
        out[to[1:] - 1] = by
        n = len(self.at) - 1
        upto = to[np.searchsorted(doc, np.arange(n + 1))]
        has = upto[1:] > upto[:-1]
        out = np.delete(out, upto[1:][has] - 1)  # the joiner after each document's last piece
        offsets = upto - np.concatenate([[0], np.cumsum(has)])
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def passes(column: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or one row."""
    sizes = np.zeros(len(column), np.int64)
    if len(column):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, total = 0, 0
    for k, size in enumerate(sizes):
        if k > lo and total + size > most:
            yield lo, k
            lo, total = k, 0
        total += int(size)
    if lo < len(sizes):
        yield lo, len(sizes)


def one(column: pa.ChunkedArray) -> pa.Array:
    """A column as a single array, large strings for text."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
