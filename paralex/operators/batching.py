"""Batches bounded by padded tokens, and pools of shuffled rows sorted by length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.operators.replay import shuffled
from paralex.operators.tables import written


def plan_sorted(counts: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int]]:
    """(length, first batch, room in it, capacity) of each (length, rows), lengths rising.

    A batch holds rows while longest * rows * 2 is within the budget.  The rows of one length fill what room the open
    batch has at that length, and then batches of their capacity.
    """
    out, batch, held = [], 0, 0
    for length, rows in counts:
        capacity = max(1, budget // (2 * length)) if length else rows + held
        room = max(0, capacity - held) if held else capacity
        if held and room == 0:
            batch, held, room = batch + 1, 0, capacity
        out.append((length, batch, room, capacity))
        if rows <= room:
            held += rows
        else:
            more = rows - room
            full = -(-more // capacity)
            batch, held = batch + full, more - (full - 1) * capacity
    return out


def sorted_batches(rows: DataFrame, length: str, key: str, budget: int) -> DataFrame:
    """rows with batch_id: in order of (length, key), greedily filled up to the budget.

    Only the counts of distinct lengths come to the driver.  Rows are numbered within range partitions, after the rows
    of their length in the partitions before, so that no length is a single task's.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, length, key).withColumn("__p", F.spark_partition_id()), "batching")
    sizes = ranged.groupBy("__p", length).agg(F.count("*").alias("__rows"))
    counts = sizes.groupBy(F.col(length).alias("length")).agg(F.sum("__rows").alias("n")).orderBy("length").collect()
    plan = plan_sorted([(r["length"], r["n"]) for r in counts], budget)
    plan = spark.createDataFrame(plan or [(0, 0, 1, 1)], "__length long, __first long, __room long, __capacity long")
    before = F.coalesce(F.sum("__rows").over(W.partitionBy(length).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sizes.withColumn("__before", before).drop("__rows")
    out = ranged.withColumn("__n", F.row_number().over(W.partitionBy("__p", length).orderBy(key))).join(before, ["__p", length])
    out = out.join(plan, F.col(length) == F.col("__length"))  # a row for each distinct length; broadcast if it is small
    at = F.col("__before") + F.col("__n") - 1
    batch = F.when(at < F.col("__room"), F.col("__first")).otherwise(F.col("__first") + 1 + F.floor((at - F.col("__room")) / F.col("__capacity")))
    return out.withColumn("batch_id", batch.cast("long")).drop("__p", "__n", "__before", "__length", "__first", "__room", "__capacity")


def next_starts(lengths: np.ndarray, budget: int) -> np.ndarray:
    """For a batch that begins at each row, the row at which the next one begins: the first that would take the batch
    over the budget, and no earlier than the row after.  Found for all rows at once: a batch grows by falling powers of
    two, its longest row known from a sparse table of maxima."""
    n = len(lengths)
    tops = [lengths]
    while 2 << (len(tops) - 1) <= min(n, max(1, budget // 2)):
        half = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    first, at, longest = np.arange(n), np.arange(n), np.zeros(n, np.int64)
    for k in reversed(range(len(tops))):
        fits = at + (1 << k) <= n
        top = np.maximum(longest, tops[k][np.where(fits, at, 0)])
        fits &= top * (at - first + (1 << k)) * 2 <= budget
        longest, at = np.where(fits, top, longest), np.where(fits, at + (1 << k), at)
    return np.maximum(at, first + 1)


def _walks(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From each row, the first batch start at or after row `size` on the walk over next starts, and the steps there."""
    at = np.append(np.where(np.arange(len(starts)) < size, starts, np.arange(len(starts))), len(starts))
    steps = np.append((np.arange(len(starts)) < size).astype(np.int64), 0)
    while True:  # pointer jumping: each step doubles
        further = at[at]
        if (further == at).all():
            return at, steps
        steps, at = steps + steps[at], further


def greedy_batches(rows: DataFrame, place: str, length: str, budget: int, block_rows: int | None = None) -> DataFrame:
    """(place, batch_id) of rows in the order of place (0, 1, ...): a batch takes rows until the next would bring
    longest * rows * 2 over the budget; a row that is longer than that is a batch of its own.  Lengths below 1 count as 1.

    Rows are cut into blocks.  Lengths of 1 or more bound a batch to budget / 2 rows, so a block that also sees as many
    rows of the next one knows where each batch that begins in it ends.  Wherever its first batch begins, among the
    first budget / 2 rows, it can tell where the next block's first one does, and how many batches lie between: a map,
    and maps of blocks are composed by doubling.  No task sees more than a block.
    """
    ahead = max(1, budget // 2)
    size = block_rows or max(64 * ahead, 1 << 16)
    if size < ahead:
        raise ValueError(f"a block takes at least {ahead} rows")
    narrow = rows.select(F.col(place).cast("long").alias("at"), F.greatest(F.lit(1), F.col(length).cast("long")).alias("size"))
    block, offset = F.floor(F.col("at") / size).cast("long"), F.col("at") % size
    both = F.when((offset < ahead) & (F.col("at") >= size), F.array(block, block - 1)).otherwise(F.array(block))
    blocks = written(narrow.select("at", "size", F.explode(both).alias("block")), "batch-blocks")

    def maps(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        starts = next_starts(table["size"].to_numpy(), budget)
        after, steps = _walks(starts, size)
        n = min(ahead, len(starts))
        columns = [pa.array([key[0].as_py()] * n, pa.int64()), pa.array(np.arange(n)), pa.array(after[:n] - size), pa.array(steps[:n])]
        return pa.table(columns, ["block", "entry", "after", "batches"])

    known = rows.sparkSession.createDataFrame([(0, 0, 0)], "block long, entry long, batches long")
    last = blocks.agg(F.max("block")).first()[0] or 0
    if last:
        hops = written(blocks.groupBy("block").applyInArrow(maps, "block long, entry long, after long, batches long"), "batch-maps")
        hop = 1
        while hop <= last:
            further = known.alias("k").join(hops.alias("h"), ["block", "entry"])
            further = further.select((F.col("block") + hop).alias("block"), F.col("after").alias("entry"), (F.col("k.batches") + F.col("h.batches")).alias("batches"))
            known = written(known.unionByName(further.where(F.col("block") <= last)), "batch-entries")
            after = hops.select((F.col("block") - hop).alias("block"), F.col("entry").alias("after"), F.col("after").alias("further"), F.col("batches").alias("more"))
            hops = hops.join(after, ["block", "after"]).select("block", "entry", F.col("further").alias("after"), (F.col("batches") + F.col("more")).alias("batches"))
            hops, hop = written(hops, "batch-maps"), 2 * hop

    def assign(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        starts = next_starts(table["size"].to_numpy(), budget)
        at, own = table["entry"][0].as_py(), min(size, len(starts))
        begins = []
        while at < own:
            begins.append(at)
            at = int(starts[at])
        number = np.searchsorted(np.array(begins, np.int64), np.arange(own), "right") - 1 + table["batches"][0].as_py()
        return pa.table([table["at"][:own], pa.array(number)], ["at", "batch_id"])

    out = blocks.join(known, "block").groupBy("block").applyInArrow(assign, "at long, batch_id long")
    return out.withColumnRenamed("at", place)


def length_pools(rows: DataFrame, length: str, key: str, seed: int, size: int = 100) -> DataFrame:
    """rows with pool: consecutive ones of the seeded order, `size` each, and position: by length within the pool."""
    placed = shuffled(rows, seed, key).withColumnRenamed("position", "__place").withColumn("pool", F.floor(F.col("__place") / size).cast("long"))
    return placed.withColumn("position", F.row_number().over(W.partitionBy("pool").orderBy(length, "__place")) - 1).drop("__place")


def shuffled_batches(rows: DataFrame, length: str, key: str, budget: int, seed: int, size: int = 100, block_rows: int | None = None) -> DataFrame:
    """rows with batch_id and turn: pools of the seeded order are sorted by length, batches filled in that order, and
    taken in an order of their own (turn, from 0).  Another epoch is another seed."""
    pooled = written(length_pools(rows, length, key, seed, size).withColumn("__at", F.col("pool") * size + F.col("position")).drop("pool", "position"), "pooled")
    batches = written(greedy_batches(pooled, "__at", length, budget, block_rows), "batches")
    turns = shuffled(batches.select("batch_id").distinct(), seed, "batch_id").withColumnRenamed("position", "turn")
    return pooled.join(batches, "__at").join(turns, "batch_id").select(*rows.columns, "batch_id", "turn")
