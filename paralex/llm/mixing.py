"""Mixing of sources to target weights by systematic sampling.

Every document of a source is expected target / source_size times.  The expected copies are prefix-summed within the
source, one random offset is added, and a copy is emitted for each integer boundary crossed.  Documents are summed in
order of size, so copies that are rounded up and down lie among documents of like size and the words taken stay within
about one document of the target.

The prefix sum is the rank of a document within its source times a constant.  Ranks are found on narrow rows (doc_id,
source, size, a hash of the rest; equal rows as one with their number): a range partitioning by (source, size, key), in
which each partition counts its rows of each source, the counts are summed over partitions, and rows are numbered inside
partitions.  A source that holds a third of all rows is thus spread over a third of the partitions, and texts, of which
the longest would meet in one of them, are only joined to their ranks, by hash.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.llm.common import stash

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Each source's words: `share` of all words by weight, none above `most` times what it has.

    Sources come by code point, null last, and take the weights in turn.  What is above a cap is dealt again by weight
    among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    caps = {s: most * sizes[s] for s in names}
    # equal to dealing again and again: caps are reached in order of cap / weight
    left, rest, out = share * sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(names, key=lambda s: caps[s] / weight[s]):
        out[s] = min(caps[s], left * weight[s] / rest)
        left -= out[s]
        rest -= weight[s]
    return out


def offset(source: str | None, seed: int) -> float:
    """One number in [0, 1) a source, alike in every run."""
    return zlib.crc32(f"{seed}:{source}".encode("utf-8", "surrogatepass")) / 2**32


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """docs (doc_id, text, source, others) with size, source_size, target, copies and taken (= copies * size).

    size: words of the text unless another column is given; a null text has none.  A document of no words gets no words
    whatever its copies.  A source without words has target 0 and no copies.  Equal rows are documents of their own.
    Columns named like the new ones are replaced.  The sources' sizes (one row a source) come to the driver.
    """
    words = F.regexp_count("text", F.lit(WORD))
    docs = docs.drop("source_size", "target", "copies", "taken", "__key", "__id", "__nth")
    own = [c for c in docs.columns if c != "size"]
    size = F.coalesce((size if size is not None else words).cast("long"), F.lit(0))
    # the key orders documents of one size: random, but alike in every run
    key = F.xxhash64(F.lit(seed), "doc_id", "text") if "text" in docs.columns else F.xxhash64(F.lit(seed), "doc_id")
    docs = docs.withColumns({"size": size, "__key": key})
    same = ["source", "size", "__key", "doc_id"]
    order = [F.col("source").asc_nulls_last(), "size", "__key", "doc_id"]
    rows = stash(docs.groupBy(same).agg(F.count("*").alias("__n")), "mixing-rows")  # a range partitioning reads twice
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = stash(ranged, "mixing")
    counts = ranged.groupBy("source", "__part").agg(F.sum("__n").alias("__rows"), F.sum(F.col("size") * F.col("__n")).alias("__size"))
    counts = stash(counts, "mixing-counts")  # rows: partitions + sources
    sizes = {r["source"]: int(r["n"]) for r in counts.groupBy("source").agg(F.sum("__size").alias("n")).collect()}
    target = targets(sizes, weights, share, most)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(s, sizes[s], target[s], target[s] / sizes[s] if sizes[s] else 0.0, offset(s, seed)) for s in sizes],
        "source string, source_size long, target double, __ratio double, __offset double",
    )
    before = W.partitionBy("source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows", "__size")
    counts = counts.join(plan, counts["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    counts = counts.withColumnsRenamed({"source": "__source", "__part": "__at"})
    inside = W.partitionBy("source", "__part").orderBy("size", "__key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    ranks = ranged.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    ranks = ranks.join(counts, (ranks["__part"] == counts["__at"]) & ranks["source"].eqNullSafe(counts["__source"]))
    ranks = ranks.withColumn("__before", F.col("__before") + F.col("__inside"))
    # texts meet their ranks, by one column without nulls; those of equal rows follow one another
    named = F.struct(
        *(F.coalesce(c, F.lit(empty)).alias(c) for c, empty in (("__key", 0), ("doc_id", 0), ("source", ""), ("size", 0))),
        *(F.col(c).isNull().alias(f"no_{c}") for c in ("doc_id", "source")),
    )
    ranks = ranks.select(named.alias("__rank"), "source_size", "target", "__before", "__ratio", "__offset")
    docs = docs.withColumn("__id", named).withColumn("__nth", F.row_number().over(W.partitionBy("__id").orderBy(F.lit(0))))
    out = docs.join(ranks, docs["__id"] == ranks["__rank"])
    upto = F.col("__before") + F.col("__nth")
    copies = F.floor(upto * F.col("__ratio") + F.col("__offset")) - F.floor((upto - 1) * F.col("__ratio") + F.col("__offset"))
    out = out.withColumn("copies", F.least(copies, F.lit(math.ceil(most)).cast("long"))).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*own, "size", "source_size", "target", "copies", "taken")
