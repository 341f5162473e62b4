"""Encoded datasets: ids of both sides, the over-length filter and its count, and directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.functions import subword


def reversed_direction(records: DataFrame) -> DataFrame:
    swap = {"source": "target", "target": "source"}
    return records.select(*(F.col(c).alias(swap.get(c, c)) for c in records.columns))


def encoded(records: DataFrame, source_model: str, target_model: str, reverse: bool = False) -> DataFrame:
    """records (source, target, others) with source_ids, target_ids and length; reverse swaps the sides and models."""
    if reverse:
        records, source_model, target_model = reversed_direction(records), target_model, source_model
    out = records.withColumns({"source_ids": subword.encode(F.col("source"), source_model), "target_ids": subword.encode(F.col("target"), target_model)})
    return out.withColumn("length", F.greatest(F.size("source_ids"), F.size("target_ids")))


def within(examples: DataFrame, maximum: int) -> DataFrame:
    return examples.where(F.col("length") <= maximum)


def lengths_report(examples: DataFrame, maximum: int) -> DataFrame:
    return examples.agg(F.count("*").alias("examples"), F.count_if(F.col("length") > maximum).alias("skipped_overlength"))
