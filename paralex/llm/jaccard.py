"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share, and the groups they form.

Filters.  A shingle that no other set has can't be shared, so a set of which too few shingles occur elsewhere is out at
once.  The rest meet by prefixes under several global orders: rarer shingles first, and among like frequencies by a
different hash in each order.  Two sets that overlap enough share a prefix shingle under every order, so the filters are
intersected, prefix against prefix, before the sets themselves meet.

Frequencies.  Documents are dealt into groups.  A group sends each of its distinct shingles once, with the number of its
sets that hold it, and is told a class of frequency for each; so a shingle that a third of all sets share costs an entry a
group.  A set that several groups hold counts once in each, which loses no link: that is a filter and an order only.

Equal sets are one class from the start, and all classes are known by a hash.  Large groups of near copies don't make
all pairs: every class is first compared to a few pivots, one for each of its commonest prefix shingles; what links joins
one component, and afterwards only pairs of classes in different components are still compared - all of them, by
parities first: each class has a bitmap that says of which parts of the range of hashes it holds an odd number of
shingles.  Every bit in which two bitmaps differ is a shingle that only one of the two has, so near misses of a large
group fall inside the join and never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import (
    SMALL_GROUP_BYTES,
    Texts,
    U,
    give_back,
    group_count,
    group_of,
    mix,
    one,
    pack_rising,
    passes,
    run_hashes,
    shuffle_partitions,
    small_batches,
    squeeze,
    stash,
    unpack_rising,
    unsqueeze,
)
from paralex.llm.components import connected_components

ORDERS = 3
#: Prefix shingles by which a class meets pivots: its commonest ones, which are what large groups of copies share.
STARS = 4
#: Lower ends of frequency classes (log2): no more shingles are common to two sets than the lesser has, class by class.
KINDS = [1, 2, 3, 6]
KIND_NAMES = [f"m{k}" for k in range(len(KINDS))]
PREFIX_NAMES = [f"p{o}" for o in range(1, ORDERS)]
#: Longs of a class's bitmap of parities.
PARITY_NAMES = [f"w{k}" for k in range(4)]
ASK_ARROW = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
TELL_ARROW = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("levels", pa.binary())])
POSTINGS = ", ".join(["token long, set long, n int, place int", *(f"{c} int" for c in KIND_NAMES), *(f"{c} long" for c in PARITY_NAMES)])
SETS = "doc_id long, n_shingles long, set long, shingles binary, levels binary"
SET_NAMES = [x.split()[0] for x in SETS.split(", ")]


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in a row, where each document's begin (and the end), and each set's hash.

    A document of fewer than k words has its whole sequence as one; without words it has none, and hash 0.
    """
    docs = len(t.at) - 1
    words, per = t.hashes(), np.diff(t.first)
    at = np.arange(max(0, len(words) - k + 1))
    at = at[t.doc[at] == t.doc[at + k - 1]]
    short = np.flatnonzero((per > 0) & (per < k))
    begin, end = np.concatenate([at, t.first[short]]), np.concatenate([at + k, t.first[short + 1]])
    doc, h = np.concatenate([t.doc[at], short]), run_hashes(words, begin, end)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if docs < 1 << 16 else np.uint32), kind="stable")]
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[fresh], h[fresh]
    upto = np.searchsorted(doc, np.arange(docs + 1))
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + U(1)), dtype=U)])
    size = np.diff(upto)
    return h, upto, np.where(size > 0, mix(total[upto[1:]] - total[upto[:-1]] + size.astype(U)), U(0))


def _texts(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, Texts]]:
    for lo, hi in passes(column, most) if most else passes(column):
        yield lo, hi, Texts(column.slice(lo, hi - lo), lower=True).words()


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class _Group:
    """The sets of a group of documents, and their distinct shingles."""

    def __init__(self, texts: pa.Array, k: int):
        parts = [shingle_sets(t, k) for _, _, t in _texts(texts)]
        self.key = np.concatenate([p[2] for p in parts] + [np.zeros(0, U)])
        self.size = np.concatenate([np.diff(p[1]) for p in parts] + [np.zeros(0, np.int64)])
        self.shingles = np.concatenate([p[0] for p in parts] + [np.zeros(0, U)])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        _, first = np.unique(self.key, return_index=True)
        self.first = first[self.size[first] > 1]  # a set of one shingle has no partner but its equals

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of distinct sets by bucket, then value; in how many of the sets each is; where buckets begin."""
        own = np.zeros(len(self.key), bool)
        own[self.first] = True
        h, count = np.unique(self.shingles[np.repeat(own, self.size)], return_counts=True)
        bucket = ((h >> U(40)) % U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        by = np.argsort(bucket, kind="stable")
        return h[by], count[by], np.searchsorted(bucket[by], np.arange(buckets + 1))


def _requests(k: int, buckets: int):
    """Of a group: every distinct shingle once, with its count, sent to the bucket of its hash."""

    def requests(key: tuple, table: pa.Table) -> pa.Table:
        h, count, cuts = _Group(one(table["text"]), k).distinct(buckets)
        count = np.minimum(count, 1 << 24).astype(np.uint32)
        rows = [(int(b), key[0].as_py(), pack_rising(h[cuts[b] : cuts[b + 1]]), squeeze(count[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts))]
        out = pa.Table.from_batches([_rows(ASK_ARROW, rows)], ASK_ARROW)
        give_back()
        return out

    return requests


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one bucket: to each group, a class of frequency for each shingle that it sent; 0: no other set has it."""
    groups, hashes, counts = (table[n].to_pylist() for n in ASK_ARROW.names[1:])
    parts = [unpack_rising(x) for x in hashes]
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    total = np.add.reduceat(np.concatenate([unsqueeze(x, np.uint32) for x in counts]).astype(np.int64)[order], begins)
    level = np.empty(len(h), np.uint8)
    level[order] = np.repeat(np.where(total > 1, np.floor(np.log2(total)), 0).astype(np.uint8), np.diff(np.append(begins, len(h))))
    ends = np.cumsum([len(x) for x in parts])
    out = pa.Table.from_batches([_rows(TELL_ARROW, [(table["b"][0].as_py(), g, squeeze(level[e - len(x) : e])) for g, x, e in zip(groups, parts, ends, strict=True)])], TELL_ARROW)
    give_back()
    return out


def _sets(k: int, percent: int, buckets: int):
    """Of a group: a row for each document, with its set; once for each set that may have a partner (enough of its
    shingles are in other sets), those shingles and their classes of frequency."""

    def sets(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(one(table["text"]), k)
        h, _, cuts = group.distinct(buckets)
        level = np.zeros(len(h), np.uint8)
        for b, x in zip(told["b"].to_pylist(), told["levels"].to_pylist(), strict=True):
            level[cuts[b] : cuts[b + 1]] = unsqueeze(x, np.uint8)
        order = np.argsort(h, kind="stable")
        h, level = h[order], level[order]
        shingles: list = [None] * len(group.key)
        levels: list = [None] * len(group.key)
        for d in group.first:
            mine = group.shingles[group.at[d] : group.at[d + 1]]
            mine_level = level[np.searchsorted(h, mine)]
            shared = mine_level > 0
            if np.count_nonzero(shared) >= needed(group.size[d], percent):
                shingles[d], levels[d] = mine[shared].tobytes(), mine_level[shared].tobytes()
        out = [table["doc_id"], group.size.astype(np.int64), group.key.view(np.int64), pa.array(shingles, pa.binary()), pa.array(levels, pa.binary())]
        out = pa.table(out, SET_NAMES)
        give_back()
        return out

    return sets


def needed(n, percent: int):
    """The least overlap that a set of n shingles has with a partner."""
    return -(-percent * n // 100)


def prefix(shingles: np.ndarray, level: np.ndarray, n: int, percent: int, order: int) -> np.ndarray:
    """The shared shingles in a set's prefix under an order; those that no other set has come before them."""
    length = n - int(needed(n, percent)) + 1 - (n - len(shingles))
    rank = np.lexsort((mix(shingles + U(order * 0x9E3779B97F4A7C15 % (1 << 64))), level))
    return shingles[rank[:length]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each of the parts of the range of hashes holds an odd number of the shingles: bits, in PARITY_NAMES' longs."""
    bits = 64 * len(PARITY_NAMES)
    slot = ((mix(shingles + U(0x5851F42D4C957F2D)) >> U(32)) % U(bits)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(bool)).view(np.int64)


def may_link(x: str, y: str, percent: int, names: list[str]) -> Column:
    """Whether two sets (columns prefixed x and y) could overlap enough, by how many of their shingles other sets have;
    with names of parity columns, also by the bits in which those differ."""
    total = lambda of: reduce(lambda s, c: s + c, of)
    both = total([F.least(f"{x}{c}", f"{y}{c}") for c in KIND_NAMES])
    if names:
        differ = total([F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in names])
        both = F.least(both, F.shiftright(total([F.col(f"{s}{c}") for s in (x, y) for c in KIND_NAMES]) - differ, 1))
    return 100 * both >= percent * (F.col(f"{x}n") + F.col(f"{y}n") - both)


def _postings(percent: int):
    """Each set's prefix shingles under the first order, the commonest last, with all that bounds and filters need."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            size, place = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            kinds = [[np.zeros(0, np.int32)] for _ in KINDS]
            bits = [[np.zeros(0, np.int64)] for _ in PARITY_NAMES]
            for s, n, h, level in zip(*(batch.column(c).to_pylist() for c in ("set", "n", "shingles", "levels")), strict=True):
                found = prefix(np.frombuffer(h, U), np.frombuffer(level, np.uint8), n, percent, 0)
                token.append(found.view(np.int64))
                key.append(np.full(len(found), s))
                size.append(np.full(len(found), n, np.int32))
                for have, count in zip(kinds, np.bincount(np.searchsorted(KINDS, np.frombuffer(level, np.uint8), "right") - 1, minlength=len(KINDS)), strict=True):
                    have.append(np.full(len(found), count, np.int32))
                for have, word in zip(bits, parities(np.frombuffer(h, U)), strict=True):
                    have.append(np.full(len(found), word))
                place.append(np.arange(len(found), dtype=np.int32)[::-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, key, size, place, *kinds, *bits)], ["token", "set", "n", "place", *KIND_NAMES, *PARITY_NAMES])

    return postings


def _prefixes(percent: int):
    """Each set with its prefixes under the other orders."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("n", "shingles", "levels")), strict=True))
            found = [[prefix(np.frombuffer(h, U), np.frombuffer(level, np.uint8), n, percent, o).view(np.int64) for n, h, level in rows] for o in range(1, ORDERS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int64())) for x in found)], [*batch.schema.names, *PREFIX_NAMES])

    return prefixes


def _verify(percent: int):
    """Pairs of sets that overlap enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for a, an, ah, b, bn, bh in zip(*(batch.column(c).to_pylist() for c in ("a", "an", "ah", "b", "bn", "bh")), strict=True):
                # both are sorted and without repeats
                x, y = np.frombuffer(ah, U), np.frombuffer(bh, U)
                spot = np.searchsorted(x, y)
                both = np.count_nonzero(x[np.minimum(spot, len(x) - 1)] == y) if len(x) else 0
                if 100 * both >= percent * (an + bn - both):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
        give_back()

    return verify


def jaccard_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, set (the class of equal sets) and component_id.

    Documents link when their sets' overlap is at least percent of their union; component_id is the least doc_id that
    links reach, the document's own included.  Documents without words, or whose text is null, link with nothing.
    Rows of one doc_id and equal sets share a class.  A null doc_id never is the least, and a component of null ids
    alone has a null one.  Letters A to Z count as lower-case.  An empty table gives no rows; other columns are not
    carried.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = group_count(docs, SMALL_GROUP_BYTES)
    buckets = max(shuffle_partitions(spark), groups // 4)
    docs = docs.withColumn("__g", group_of(F.xxhash64("doc_id", "text"), groups))

    asks = docs.groupBy("__g").applyInArrow(_requests(shingle, buckets), "b int, g int, hashes binary, counts binary")
    tells = asks.groupBy("b").applyInArrow(_frequencies, "b int, g int, levels binary")
    found = stash(docs.groupBy("__g").cogroup(tells.groupBy("g")).applyInArrow(_sets(shingle, percent, buckets), SETS), "sets")
    # a document without shingles is a class of its own
    members = found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set")).otherwise(F.xxhash64(F.lit("none"), "doc_id")).alias("set"))
    sets = found.where("shingles is not null").dropDuplicates(["set"]).select("set", F.col("n_shingles").cast("int").alias("n"), "shingles", "levels")
    with small_batches(spark, 400):
        sets = sets.mapInArrow(_prefixes(percent), "set long, n int, shingles binary, levels binary, " + ", ".join(f"{p} array<long>" for p in PREFIX_NAMES))
        sets = stash(sets, "classes")
        postings = stash(sets.select("set", "n", "shingles", "levels").mapInArrow(_postings(percent), POSTINGS), "postings")

    def linked(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) that share a prefix shingle under every order, and then overlap enough; the side that may repeat
        without bound (b) is joined first."""
        prefixes = lambda p: sets.select(F.col("set").alias(p), *(F.col(c).alias(f"{p}{c}") for c in PREFIX_NAMES))
        met = pairs.join(prefixes("b"), "b").join(prefixes("a"), "a")
        for c in PREFIX_NAMES:
            met = met.where(F.arrays_overlap(f"a{c}", f"b{c}"))
        met = stash(met.select("a", "b"), "met")
        side = lambda p: sets.select(F.col("set").alias(p), F.col("n").alias(f"{p}n"), F.col("shingles").alias(f"{p}h"))
        wide = met.join(side("b"), "b").join(side("a"), "a").select("a", "an", "ah", "b", "bn", "bh")
        with small_batches(spark, 100):  # a row holds two whole sets
            return stash(wide.mapInArrow(_verify(percent), "a long, b long"), "linked")

    def side(df: DataFrame, x: str, *others: str) -> DataFrame:
        return df.select("token", F.col("set").alias(x), *(F.col(c).alias(f"{x}{c}") for c in ("n", *KIND_NAMES, *others)))

    # every class and a few pivots: of a shingle's classes the one with the fewest shingles of its own, which is nearest
    # to what copies have in common
    own = F.col("n") - reduce(lambda x, c: x + F.col(c), KIND_NAMES[1:], F.col("m0"))
    lead = F.struct(own.alias("own"), F.xxhash64("token", "set").alias("chance"), *("set", "n", *KIND_NAMES))
    pivots = stash(side(postings.groupBy("token").agg(F.min(lead).alias("p")).select("token", "p.*"), "b"), "pivots")
    pairs = side(postings.where(F.col("place") < STARS), "a").join(pivots, "token").where((F.col("a") != F.col("b")) & may_link("a", "b", percent, []))
    links = linked(pairs.select("a", "b").distinct())
    parts = stash(connected_components(links), "parts")

    # all pairs of classes that are still apart
    apart = postings.join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    apart = stash(apart, "apart")
    mixed = apart.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    mixed = stash(mixed, "mixed")
    apart = apart.join(mixed, "token", "left_semi")
    rest = side(apart, "a", "root", *PARITY_NAMES).join(side(apart, "b", "root", *PARITY_NAMES), "token")
    rest = rest.where((F.col("aroot") < F.col("broot")) & may_link("a", "b", percent, PARITY_NAMES)).select("a", "b").distinct()
    more = linked(rest)
    roots = connected_components(links.union(more)).withColumnsRenamed({"node": "set"})

    least = members.groupBy("set").agg(F.min("doc_id").alias("least")).join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = stash(least, "least")
    heads = least.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stash(least.join(heads, "root").select("set", "component_id"), "labels")
    return members.join(labels, "set").select("doc_id", "n_shingles", "set", "component_id")
