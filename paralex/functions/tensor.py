"""Tensor-shaped functions over arrays: decoding scores, losses, schedules, tables, padding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.functions.text import let


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def log_softmax(logits: Column) -> Column:
    def shifted(x: Column, top: Column) -> Column:
        total = F.log(_sum(F.transform(x, lambda v: F.exp(v - top)))) + top
        return let([x, total], lambda x, total: F.transform(x, lambda v: v - total))

    x = F.transform(logits, lambda v: v.cast("double"))
    return let([x, F.array_max(x)], shifted)


def argmax(x: Column) -> Column:
    """Position from 0 of the largest, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def top_k(x: Column, k: int) -> Column:
    """Positions from 0 of the k largest, largest first, of equals the first."""
    ranked = F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])


def smoothed_cross_entropy(log_p: Column, label: Column, smoothing: float) -> Column:
    """Loss of one token: the label's share and the rest spread over all classes."""
    return -((1 - smoothing) * F.element_at(log_p, label + 1) + smoothing / F.size(log_p) * _sum(log_p))


def beam_score(total: Column, length: Column, alpha: float) -> Column:
    return total / F.pow((length + 5) / 6.0, F.lit(alpha))


def confidence(log_p: Column) -> Column:
    """exp of the mean log-probability; 0 for no tokens."""
    return F.when(F.size(log_p) == 0, F.lit(0.0)).otherwise(F.exp(_sum(log_p) / F.size(log_p)))


def pad_and_shift(df: DataFrame, batch: str, source: str, target: str, pad: int = 0) -> DataFrame:
    """Pads to the longest of each batch; target_in lacks the last id, target_out the first."""
    own = W.partitionBy(batch)
    widest = lambda c: F.max(F.size(c)).over(own)
    padded = lambda c, n: F.concat(F.col(c), F.array_repeat(F.lit(pad).cast(df.schema[c].dataType.elementType), F.col(n) - F.size(c)))
    out = df.withColumns({"__s": widest(source), "__t": widest(target)})
    out = out.withColumns({"source_padded": padded(source, "__s"), "__padded": padded(target, "__t")})
    return out.withColumns({"target_in": F.slice("__padded", F.lit(1), F.greatest(F.lit(0), F.col("__t") - 1)), "target_out": F.slice("__padded", F.lit(2), F.greatest(F.lit(0), F.col("__t") - 1))}).drop("__s", "__t", "__padded")


def schedule(step: Column, kind: str, warmup: int, total: int) -> Column:
    """Learning-rate multiplier at a step from 1: linear warm-up, then inverse_sqrt, cosine or constant."""
    if kind == "inverse_sqrt":
        after = F.sqrt(F.lit(float(max(1, warmup))) / step)
    elif kind == "cosine":
        progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(float(max(1, total - warmup)))))
        after = 0.5 * (1 + F.cos(progress * math.pi))
    else:
        after = F.lit(1.0)
    return F.when(step <= warmup, step / F.lit(float(warmup))).otherwise(after) if warmup else after


def positional_table(rows: DataFrame, position: str, width: int) -> DataFrame:
    """rows with (channel, value), a row each: sines in even channels, cosines in odd ones."""
    grid = rows.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    angle = F.col(position) * F.exp((F.col("channel") - F.col("channel") % 2) * F.lit(-math.log(10000.0) / width))
    return grid.withColumn("value", F.when(F.col("channel") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)))


def causal_mask(rows: DataFrame, sequence: str, position: str) -> DataFrame:
    """(sequence, place, other, masked) of the positions of each sequence: one may not see those after it."""
    place, other = (rows.select(sequence, F.col(position).alias(n)) for n in ("place", "other"))
    return place.join(other, sequence).withColumn("masked", F.col("other") > F.col("place"))
