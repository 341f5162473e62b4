"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into Lempel-Ziv (LZ78) phrases: each is the shortest run not met as a phrase before.
The phrases' hashes are dealt into bins, and the least of each bin makes the signature.  Two signatures are alike in the
share of bins, among those that either fills, in which they agree: an estimate of the overlap of the two phrase sets.

The parse is a loop over bytes in Python, one dictionary probe a byte; hashing and signatures are NumPy.  A text that
shares its beginning with another is parsed from there on only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import U, mix, one, run_hashes, shuffle_partitions

BINS = 128


def parse(data: bytes, seen: dict[int, int], ends: list[int], begin: int = 0, cur: int = 0) -> int:
    """Parses data[begin:] on; seen: phrases as child of (phrase, byte); ends: the phrases' ends.  Returns the phrase
    that is open at the end (0: none)."""
    get, add = seen.get, ends.append
    number = len(seen) + 1
    for at, c in enumerate(data[begin:] if begin else data, begin + 1):
        key = cur | c
        nxt = get(key)
        if nxt is None:
            seen[key] = number << 8
            number += 1
            add(at)
            cur = 0
        else:
            cur = nxt
    return cur


def signature(data: bytes, ends: list[int], bins: int = BINS) -> np.ndarray:
    """Least hash (32 bits, from 1) of the phrases in each bin, 0 where there is none; an open last phrase counts."""
    stops = np.array(ends if ends and ends[-1] == len(data) else [*ends, len(data)] if data else [], np.int64)
    out = np.zeros(bins, np.uint32)
    if len(stops):
        starts = np.concatenate([[0], stops[:-1]])
        h = mix(run_hashes(np.frombuffer(data, np.uint8).astype(U) + U(1), starts, stops))
        least = np.full(bins, 1 << 32, np.uint64)
        np.minimum.at(least, (h >> U(40)) % U(bins), (h & U(0xFFFFFFFF)) | U(1))
        out[:] = np.where(least < U(1 << 32), least, U(0)).astype(np.uint32)
    return out


def written(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fills; two empty signatures are alike."""
    either = int(np.count_nonzero((a != 0) | (b != 0)))
    return float(np.count_nonzero((a == b) & (a != 0))) / either if either else 1.0


class Parsed:
    """A text with its fingerprint, and the state of the parse where its last half begins."""

    def __init__(self, text: str):
        self.text = text
        cut = len(text) - len(text) // 2
        head, tail = text[:cut].encode("utf-8", "surrogatepass"), text[cut:].encode("utf-8", "surrogatepass")
        self.head, seen, ends = head, {}, []
        self.cur = parse(head, seen, ends)
        self.seen, self.ends = dict(seen), list(ends)
        parse(head + tail, seen, ends, len(head), self.cur)
        self.sketch = signature(head + tail, ends)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text whose last half gives way to other's beginning, and its signature; uses the state up."""
        half = len(self.text) // 2
        tail = other[:half]
        data = self.head + tail.encode("utf-8", "surrogatepass")
        parse(data, self.seen, self.ends, len(self.head), self.cur)
        sketch = signature(data, self.ends)
        self.seen = self.ends = None
        return self.text[: len(self.text) - half] + tail, sketch


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in chunks of rising doc_id, each sorted and ended by the row that comes next.

    Adds __chunk, and __ends: the row only ends its chunk.  Chunks are cut at quantiles of doc_id; the first row of each
    also ends the chunk before, and that of the first chunk the last.  Rows of equal doc_id stay in one chunk.
    """
    spark = docs.sparkSession
    chunks = shuffle_partitions(spark) * 2
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.withColumn("__key", key)
    cuts = docs.agg(F.percentile_approx("__key", [k / chunks for k in range(1, chunks)], 10 * chunks).alias("q")).first()["q"] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def chunk(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64)).astype(np.int32))

    heads = docs.select("__key").withColumn("__chunk", chunk("__key")).groupBy("__chunk").agg(F.min("__key").alias("head")).orderBy("__chunk").collect()  # a row a chunk
    head = np.array([r["head"] for r in heads], np.int64)
    whose = np.array([r["__chunk"] for r in heads], np.int32)

    @F.pandas_udf("array<int>")
    def chunks_of(keys: pd.Series) -> pd.Series:
        """A row's chunk and, of a head, the one that it ends."""
        keys = keys.to_numpy(np.int64)
        at = np.searchsorted(head, keys, "right") - 1
        first = head[at] == keys
        return pd.Series([[whose[k], whose[k - 1]] if f else [whose[k]] for k, f in zip(at.tolist(), first.tolist(), strict=True)])

    to = F.posexplode(chunks_of("__key")).alias("__nth", "__chunk")
    out = docs.select("doc_id", "text", "__key", to).withColumn("__ends", F.col("__nth") == 1).drop("__nth")
    return out.repartition(chunks, "__chunk").sortWithinPartitions("__chunk", "__ends", "__key", "text")


FINGERPRINTS = "doc_id long, n_chars long, edited_text_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrase_fingerprints(docs: DataFrame) -> DataFrame:
    """FINGERPRINTS of docs (doc_id, text): each text, and its edited text: the last floor(n_chars / 2) code points give
    way to the first as many (or all) of the next document by doc_id (after the last: the first).

    A null text is empty, and an empty one's signature has no phrases; two of those are alike by 1.  A null doc_id comes
    before all others; rows of one doc_id come by text, null first.  A single row is its own next.  Other columns are
    not carried.
    """
    import hashlib

    def scan(batches):
        before, chunk, rows = None, None, []

        def out():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in FINGERPRINTS.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "text", "__chunk", "__ends")]
            for doc_id, text, c, ends in zip(*columns, strict=True):
                text = text or ""
                if c != chunk:
                    before, chunk = None, c
                elif before is not None and before[2]:
                    continue  # more rows share the doc_id that ends the chunk
                now = Parsed(text)
                if before is not None:
                    whose, was, _ = before
                    edited, sketch = was.edited(text)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((whose, len(was.text), digest, written(was.sketch), written(sketch), likeness(was.sketch, sketch), likeness(was.sketch, now.sketch)))
                before = (doc_id, now, ends)
            yield out()

    return with_next(docs.select("doc_id", "text")).select("doc_id", "text", "__chunk", "__ends").mapInArrow(scan, FINGERPRINTS)
