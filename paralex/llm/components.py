"""Connected components of a graph of links, as DataFrame rounds (large-star and small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (larger ones, or the others and itself) to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b: long); root: the least node that it reaches.

    Each round is written to the shared folder; rounds go on until the links are stars.  Their number grows with the
    logarithm of the largest component.  Loops and repeated links do no harm.
    """
    edges = stash(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        edges = stash(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
