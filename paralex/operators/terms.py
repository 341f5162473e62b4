"""Terminology: which terms of a dictionary texts hold, found in one pass over a text.

Terms and texts are folded once, before they meet.  A small dictionary becomes a pair of Aho-Corasick automata (terms,
and the forms asked for), built once a Python worker.  A larger one never is in one place: it is told to the texts as a
bitmap of hashes, of the terms and of their first letters.  A text's windows that the bitmap doesn't exclude, of lengths
that terms have, are joined to the terms by their letters, so what is left out is left out by the join, and a text is
read once whatever the dictionary's size.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.functions import text as T
from paralex.operators.tables import written

#: Characters of terms and forms that automata are built of, about; what a task is sent.
SHARD_CHARACTERS = 4 << 20
#: First letters of a term that a window is looked up by, before whole windows are.
HEAD = 8
#: Bits of the bitmap for each term, and at most in all (64 MB): with more terms it excludes less, which costs time only.
TERM_BITS, MOST_BITS = 32, 1 << 29
#: Characters of texts whose windows are hashed at a time.
CHUNK = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

_built: dict[str, tuple] = {}


class Matcher:
    """The numbers of the patterns that a text holds; the empty pattern is in every text."""

    def __init__(self, patterns: dict[str, list[int]]):
        import ahocorasick

        self.always = patterns.get("", [])
        self.automaton = ahocorasick.Automaton()
        for pattern, numbers in patterns.items():
            if pattern:
                self.automaton.add_word(pattern, numbers)
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, text: str) -> set[int]:
        found = set(self.always)
        if len(self.automaton):
            for _, numbers in self.automaton.iter(text):
                found.update(numbers)
        return found


def _matchers(name: str, rows: list[tuple[str, list[str]]]) -> tuple[Matcher, Matcher, list[list[int]]]:
    """Matchers of terms and of forms, and the forms of each term; kept for the worker's next tasks of this shard."""
    if name not in _built:
        _built.clear()
        terms, forms = defaultdict(list), {}
        for number, (term, _) in enumerate(rows):
            terms[term].append(number)
        of = [[forms.setdefault(f, len(forms)) for f in fs] for _, fs in rows]
        _built[name] = Matcher(terms), Matcher({f: [k] for f, k in forms.items()}), of
    return _built[name]


def _shard(folded: DataFrame, rows: list[tuple[str, list[str]]]) -> DataFrame:
    """(matched, total) of each batch of folded (source, candidate) for the terms of a shard."""
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, forms, of = _matchers(name, rows)
        matched = total = 0
        for batch in batches:
            for source, candidate in zip(batch.column("source").to_pylist(), batch.column("candidate").to_pylist(), strict=True):
                asked = terms(source) if source is not None else ()
                if asked:
                    said = forms(candidate) if candidate is not None else set()
                    total += len(asked)
                    matched += sum(not said.isdisjoint(of[k]) for k in asked)
        yield pa.RecordBatch.from_arrays([pa.array([matched]), pa.array([total])], ["matched", "total"])

    return folded.mapInArrow(scan, "matched long, total long")


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class _Windows:
    """Hashes of all windows of a run of characters."""

    def __init__(self, text: str):
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        power = np.cumprod(np.concatenate([[U(1)], np.full(len(letters), U(_BASE))]), dtype=U)
        self.upto = np.concatenate([np.zeros(1, U), np.cumsum(_stirred(letters + U(1)) * power[:-1], dtype=U)])
        self.back = np.cumprod(np.concatenate([[U(1)], np.full(len(letters), U(_BACK))]), dtype=U)

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _stirred((self.upto[at + length] - self.upto[at]) * self.back[at] + np.asarray(length).astype(U))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    return (h & U(bits - 1)).astype(np.int64), ((h >> U(32)) & U(bits - 1)).astype(np.int64)


def _bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """The bits of all terms and of their heads."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("term").to_pylist()
            text, size = _Windows("".join(words)), np.array([len(w) for w in words], np.int64)
            at = np.cumsum(size) - size
            h = np.unique(np.concatenate([text.hashes(at, size), text.hashes(at, np.minimum(size, HEAD))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_slots(h, bits))) + 1)], ["slot"])  # Spark's buckets begin at 1

    parts = words.select("term").mapInArrow(slots, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # of fixed size
        out[(r["k"] - 1) * len(r["m"]) : r["k"] * len(r["m"])] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _candidates(folded: DataFrame, bitmap: np.ndarray, bits: int, lengths: list[int]) -> DataFrame:
    """(term, candidate): windows of each source that may be terms, each once a row."""
    shared = folded.sparkSession.sparkContext.broadcast(bitmap)

    def known(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for slot in _slots(h, bits):
            out &= (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
        return out

    def windows(texts: list[str]) -> list[set[str]]:
        whole, size = "".join(texts), np.array([len(x) for x in texts], np.int64)
        text, ends = _Windows(whole), np.cumsum(size)
        row = np.repeat(np.arange(len(texts)), size)
        left = ends[row] - np.arange(len(row))
        out: list[set[str]] = [set() for _ in texts]
        every = np.arange(len(row))
        heads = every[left >= HEAD]
        heads = heads[known(text.hashes(heads, HEAD))]
        for length in lengths:
            at = heads if length >= HEAD else every
            at = at[left[at] >= length]
            for k in at[known(text.hashes(at, length))].tolist():
                out[row[k]].add(whole[k : k + length])
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, candidates = batch.column("source").to_pylist(), batch.column("candidate").to_pylist()
            lo = 0
            while lo < len(sources):
                hi, size = lo, 0
                while hi < len(sources) and (hi == lo or size < CHUNK):
                    size += len(sources[hi] or "")
                    hi += 1
                found = windows([x or "" for x in sources[lo:hi]])
                pairs = [(w, c) for ws, c in zip(found, candidates[lo:hi], strict=True) for w in ws]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.string())], ["term", "candidate"])
                lo = hi

    return folded.mapInArrow(scan, "term string, candidate string")


def _joined(folded: DataFrame, words: DataFrame) -> DataFrame:
    """(matched, total) of folded (source, candidate) for a dictionary of any size; the empty term is left out."""
    words = words.where("term <> ''").select("term", "forms")
    seen = words.groupBy(F.length("term").alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect()  # a row a length
    bits = 1 << 20
    while bits < min(MOST_BITS, TERM_BITS * sum(r["n"] for r in seen)):
        bits *= 2
    met = _candidates(folded, _bitmap(words, bits), bits, [r["length"] for r in seen]).join(words, "term")
    said = F.coalesce(F.exists("forms", lambda f: F.contains("candidate", f)), F.lit(False))
    return met.agg(F.count_if(said).alias("matched"), F.count("*").alias("total"))


def terminology(rows: DataFrame, terms: DataFrame, shard_characters: int = SHARD_CHARACTERS) -> DataFrame:
    """One row (matched, total, accuracy): of the terms (term, forms) that a source holds, case folded, those whose
    candidate holds a form; accuracy is 1 where no term is met.

    rows: (source, candidate).  Null texts hold nothing, null terms and forms are in nothing; the empty term is in every
    text.  Each row of terms counts, repeated ones too.
    """
    folded = rows.select(T.casefold(F.col("source")).alias("source"), T.casefold(F.col("candidate")).alias("candidate"))
    forms = F.transform(F.filter(F.coalesce("forms", F.array().cast("array<string>")), lambda f: f.isNotNull()), T.casefold)
    words = terms.where(F.col("term").isNotNull()).select(T.casefold(F.col("term")).alias("term"), forms.alias("forms"))
    words = written(words.withColumn("size", F.length("term") + F.aggregate("forms", F.lit(0), lambda a, f: a + F.length(f) + 1)), "terms")
    shards = max(1, -(-(words.agg(F.sum("size")).first()[0] or 0) // shard_characters))
    collected = lambda df: [(r["term"], list(r["forms"])) for r in df.select("term", "forms").collect()]
    if shards == 1:
        out = _shard(folded, collected(words))
    else:
        out = _joined(folded, words)
        if empty := collected(words.where("term = ''")):
            out = out.unionByName(_shard(folded, empty))
    out = out.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return out.withColumn("accuracy", F.when(F.col("total") == 0, 1.0).otherwise(F.col("matched") / F.col("total")))
