"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it meets a fixed set of pivots, nearest first.  A row posts its place to
the lists of its nearest quarter of the pivots: pivot by pivot, a block of rows is an inverted file, written once
as a table.  A query walks the lists of its own nearest pivots only (an eighth of all) and adds up, for the rows
posted there, how far the ranks differ: the footrule distance.  A row that a list doesn't hold counts as ranked just
after those that it holds; one that no list holds has the greatest footrule, and is scored where estimates reach it.

The rows of least footrule are reranked first, by the exact measure.  What they score tells the query what a footrule is
worth: a line through their cosines, and how far they scatter about it.  Reranking goes on, best estimates first and the
line drawn anew each time, while a row's length times its estimated cosine plus three standard deviations reaches the
k-th best score.  So dense clusters, in which ranks tell little, are searched further than clear neighbourhoods, and long
rows earlier than short ones.  No number of candidates is fixed.

The query set is stated (a share of all rows), so queries meet all rows in blocks: block by block of rows and of
queries, and each pair of blocks returns the k nearest that it found of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.llm.common import one, stash

PIVOTS = 256
#: Rows for each pivot in the sample that pivots are chosen from.
SAMPLE = 8
ROW_BLOCK, QUERY_BLOCK = 16_384, 2048
#: Part of a cosine that rounding may cost.
SLACK = 1e-9
INDEX = "rb int, ids binary, vectors binary, lengths binary, members array<binary>, ranks array<binary>"
NEAREST = "query_id long, vec_id long, score double, scored long"


def valid(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(numbers, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n directions of the sample, each the farthest from those before it: a cluster gets no more than it spans."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken, near = [0], unit @ unit[0]
    while len(taken) < min(n, len(unit)):
        near[taken[-1]] = np.inf
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Of each vector (row), its n nearest pivots, nearest first, by inner product of directions."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :n]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _index(pivots: np.ndarray, posted: int):
    """Of a block of rows: their vectors, and for each pivot a list of the rows posted there and one of their ranks."""

    def index(key: tuple, rows: pa.Table) -> pa.Table:
        ids, vectors = one(rows["vec_id"]).to_numpy(), matrix(one(rows["embedding"]))
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        pivot = nearest_pivots(vectors, pivots, posted).ravel()
        by = np.argsort(pivot, kind="stable")
        cuts = np.searchsorted(pivot[by], np.arange(1, len(pivots)))
        members, ranks = np.split((by // posted).astype(np.int32), cuts), np.split((by % posted).astype(np.uint8), cuts)
        row = [key[0].as_py(), ids.tobytes(), vectors.tobytes(), np.linalg.norm(vectors, axis=1).tobytes(), [x.tobytes() for x in members], [x.tobytes() for x in ranks]]
        kinds = [pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.binary())] * 2]
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["rb", "ids", "vectors", "lengths", "members", "ranks"])

    return index


def rerank(foot: np.ndarray, longest: np.ndarray, score, own: np.ndarray, k: int, share: float, least: int, spare: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are worth scoring, and their scores.  foot: footrule of each row; longest: what a row scores at a cosine
    of one; score: gives rows' scores; own: marks rows that are no candidates; spare: standard deviations allowed."""
    step = max(least, int(np.ceil(share * len(foot))))
    left = ~own
    todo = np.flatnonzero(left)
    if len(todo) > step:
        todo = todo[np.argpartition(foot[todo], step - 1)[:step]]
    near, found = todo[:0], np.zeros(0)
    while len(todo):
        near, found = np.concatenate([near, todo]), np.concatenate([found, score(todo)])
        left[todo] = False
        reach = np.partition(found, -k)[-k] if len(found) >= k else -np.inf
        x, y = foot[near], found / longest[near]
        away = x - x.mean()
        spread_of = (away * away).mean()
        slope = min(0.0, (away * y).mean() / spread_of) if spread_of > 0 else 0.0
        level = y.mean() - slope * x.mean()
        scatter = np.sqrt(np.square(y - level - slope * x).mean())
        most = longest * (level + slope * foot + spare * scatter + SLACK)
        todo = np.flatnonzero(left & ~(most < reach))
        if len(todo) > step:
            todo = todo[np.argpartition(-most[todo], step - 1)[:step]]
    return near, found


def _search(k: int, posted: int, share: float, least: int, spare: float):
    def search(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        asked, asked_vectors = one(queries["vec_id"]).to_numpy(), matrix(one(queries["embedding"]))
        probes = [np.frombuffer(x, np.uint8) for x in queries["probes"].to_pylist()]
        for block in blocks.to_pylist():
            ids, length = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["lengths"])
            vectors = np.frombuffer(block["vectors"]).reshape(len(ids), -1)
            members = [np.frombuffer(x, np.int32).astype(np.intp) for x in block["members"]]
            # what a row gains where it is on a list: negative, from "ranked just after those on lists" to its rank
            ranks = [np.frombuffer(x, np.uint8).astype(np.float32) for x in block["ranks"]]
            for q, (own, probe) in enumerate(zip(asked_vectors, probes, strict=True)):
                foot = np.full(len(ids), sum(posted - n for n in range(len(probe))), np.float32)
                for n, pivot in enumerate(probe):
                    foot[members[pivot]] += np.abs(ranks[pivot] - n) - (posted - n)
                longest = length * np.linalg.norm(own)
                near, score = rerank(foot, longest, lambda rows, own=own: (vectors[rows] * own).sum(axis=1), ids == asked[q], k, share, least, spare)
                top = best(ids[near], score, k)
                scored = np.zeros(len(top), np.int64)
                scored[:1] = len(near)
                for x, y in zip(out, (np.full(len(top), asked[q]), ids[near][top], score[top], scored), strict=True):
                    x.append(y)
        cols = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64, np.int64), strict=True)]
        return pa.table(cols, ["query_id", "vec_id", "score", "scored"])

    return search


def permutation_search(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, share: float = 0.02, least: int = 64, spare: float = 3.0) -> DataFrame:
    """The k nearest found of each query of vectors (vec_id, embedding): query_id, rank, vec_id, score, scored.

    Nearest is by largest inner product, ties to smaller vec_id.  is_query marks the queries; candidates are all rows
    but those of the query's own id.  scored: how many rows the query was compared to by the exact measure.  The index
    holds every row; its pivots (at most 256) are spread over a sample of SAMPLE rows a pivot, chosen by a hash of
    vec_id.  share and least: the part of a block's rows that is reranked at a time, and how many at least; spare: the
    standard deviations by which an estimate may fall short.

    Rows of null vec_id take no part, nor do vectors that are null, zero or hold a null or non-finite component, nor
    those whose length is not the commonest (of equals the least).  Of rows of one vec_id the least vector counts.  Equal
    vectors of different ids are all kept.  With fewer than k candidates all are returned.  Other columns are not carried.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("query").alias("query"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.count_if("query").alias("queries"))
    common = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    if not common or not common[0]["queries"]:
        return empty
    rows = rows.where(F.size("embedding") == common[0]["size"])
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * pivots).collect()
    fixed = spread(np.array([r["embedding"] for r in sample], np.float64), pivots)
    posted, probed = -(-len(fixed) // 4), -(-len(fixed) // 8)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(one(batch.column("embedding")))
            found = nearest_pivots(x, fixed, probed).astype(np.uint8) if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in found], pa.binary())], [*batch.schema.names, "probes"])

    kind = rows.schema["embedding"].dataType.simpleString()
    row_blocks = -(-common[0]["n"] // ROW_BLOCK)
    query_blocks = -(-common[0]["queries"] // QUERY_BLOCK)
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = stash(rows.groupBy(block(row_blocks, 1).alias("rb")).applyInArrow(_index(fixed, posted), INDEX), "index")
    asked = rows.where("query").select("vec_id", "embedding").mapInArrow(probes, f"vec_id long, embedding {kind}, probes binary")
    asked = asked.withColumn("qb", block(query_blocks, 2)).withColumn("rb", every(row_blocks))
    held = index.withColumn("qb", every(query_blocks))
    pairs = held.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInArrow(_search(k, posted, share, least, spare), NEAREST)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    scored = F.sum("scored").over(W.partitionBy("query_id"))
    return pairs.withColumn("rank", rank).withColumn("scored", scored).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")
