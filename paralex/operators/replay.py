"""Replay: which rows are new, and a mixture of new rows and a sample of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.operators.tables import written

KEYS = ["source", "target"]


def new_rows(current: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows of current whose (source, target) the parent lacks; repeats stay.  Told by digests: no text travels as a key,
    and the parent's rows are 32 bytes each.  A row with a null side is in no parent."""
    digest = F.unhex(F.sha2(F.concat(F.col("source"), F.lit("\0"), F.sha2(F.col("target"), 256)), 256))
    there = parent.select(digest.alias("__key")).distinct()
    return current.withColumn("__key", digest).join(there, "__key", "left_anti").drop("__key")


def domain_pool(history: DataFrame, new: DataFrame) -> DataFrame:
    """History of the new rows' domains, or all of it where none is."""
    domains = new.where(F.col("domain").isNotNull() & (F.col("domain") != "")).select("domain").distinct()
    pool = history.join(domains, "domain", "left_semi").select(history.columns)
    return history if pool.isEmpty() else pool


def chance(seed: int, key: Column) -> Column:
    """A row's place in the seeded order, alike in every engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def sample(rows: DataFrame, count: int, seed: int, key: str) -> DataFrame:
    """count rows in seeded order: each at most once, or drawn with replacement where there are too few.

    Without replacement these are the first of the seeded order, and no row moves: counts by the first 16 bits of the draw
    tell where the sample ends, and only rows that share those bits are put in order.  With replacement, draw i takes the
    row that the hash of i points to.
    """
    draw = chance(seed, F.col(key))
    part = F.coalesce(F.conv(F.substring(draw, 1, 4), 16, 10).cast("int"), F.lit(-1))  # null keys come first
    parts = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # 65,537 at most
    size = sum(n for _, n in parts)
    if count <= 0 or size == 0:
        return rows.limit(0)
    if count == size:
        return rows
    if count < size:
        left = count
        for cut, n in parts:
            if left < n:
                break
            left -= n
        sure = rows.where(part < cut)
        return sure.unionByName(rows.where(part == cut).orderBy(draw, key).limit(left)) if left else sure
    numbered = shuffled(rows, seed, key).withColumnRenamed("position", "__n")
    draws = rows.sparkSession.range(count).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(size)).alias("__n"))
    return draws.join(numbered, "__n").drop("__n")


def history_count(strategy: str, new: int, *, fixed: int = 0, new_ratio: float = 0.5, history_ratio: float = 0.5) -> int:
    """Rows of history that a strategy asks for; percentage and weighted are one rule, rounded half to even."""
    if strategy == "fixed_count":
        return fixed
    if strategy in ("percentage", "weighted"):
        return round(new * (history_ratio / max(new_ratio, 1e-9)))
    if strategy in ("balanced", "domain_aware"):
        return new
    raise ValueError(f"unknown replay strategy: {strategy}")


def mixture(new: DataFrame, history: DataFrame, strategy: str | None, seed: int, key: str, **options: float) -> tuple[DataFrame, dict]:
    """(new rows and sampled history, report); strategy None: new rows alone."""
    new = written(new, "new")  # told apart from history once; counts, domains and rows are read from there
    n, available = new.count(), history.count()
    if n == 0:
        raise ValueError("no new training rows")
    if strategy is None:
        out, drawn = new.withColumn("replayed", F.lit(False)), 0
    else:
        if available == 0:
            raise ValueError("replay needs history")
        drawn = history_count(strategy, n, **options)
        pool = domain_pool(history, new) if strategy == "domain_aware" else history
        out = new.withColumn("replayed", F.lit(False)).unionByName(sample(pool, drawn, seed, key).withColumn("replayed", F.lit(True)))
    report = {
        "mode": "replay" if strategy else "new_data_only",
        "strategy": strategy,
        "new_examples": n,
        "available_historical_examples": available,
        "sampled_historical_examples": drawn,
        "training_examples": n + drawn,
        "effective_new_fraction": n / max(1, n + drawn),
        "catastrophic_forgetting_warning": strategy is None,
    }
    return out, report


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """rows with position, their place in a seeded order (from 0)."""
    return numbered(rows.withColumn("__draw", chance(seed, F.col(key))), "__draw", key).drop("__draw")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with position, their place in an order (from 0).

    Rows are numbered within range partitions, after those of the partitions before; only counts meet in one place.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n")).select("__p", before.alias("__before"))  # a row a partition
    place = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    out = ranged.withColumn("__place", place).join(counts, "__p")
    return out.withColumn("position", F.col("__before") + F.col("__place")).drop("__p", "__before", "__place")
