"""Comparison of two versions: metric deltas, promotion gates, configuration and dataset differences, changed outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gates: (check, metric, sign of candidate less baseline, whether the bound is a least value).
GATES = [
    ("minimum_chrf_change", "chrf", 1, True),
    ("maximum_bleu_regression", "bleu", -1, False),
    ("maximum_number_accuracy_regression", "number_accuracy", -1, False),
    ("maximum_placeholder_accuracy_regression", "placeholder_accuracy", -1, False),
]


def metric_deltas(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, a, b, delta) of the metrics (metric, value) that both have."""
    left, right = a.withColumnRenamed("value", "a"), b.withColumnRenamed("value", "b")
    return left.join(right, [*keys, "metric"]).withColumn("delta", F.col("b") - F.col("a"))


def gates(baseline: DataFrame, candidate: DataFrame, limits: dict[str, float], *keys: str) -> DataFrame:
    """(keys, check, actual, required, passed) of the gates whose metrics both (keys, metric, value) tables have."""
    spark = baseline.sparkSession
    rules = spark.createDataFrame([(c, m, s, least, float(limits[c])) for c, m, s, least in GATES], "check string, metric string, sign int, least boolean, required double")
    both = rules.join(baseline.withColumnRenamed("value", "was"), "metric").join(candidate.withColumnRenamed("value", "now"), [*keys, "metric"])
    both = both.withColumn("actual", F.col("sign") * (F.col("now") - F.col("was")))
    return both.select(*keys, "check", "actual", "required", F.when(F.col("least"), F.col("actual") >= F.col("required")).otherwise(F.col("actual") <= F.col("required")).alias("passed"))


def all_passed(checks: DataFrame, *keys: str) -> DataFrame:
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("passed"))


def config_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, version_a, version_b) of the flattened settings (path, value) that are not equal."""
    left, right = a.withColumnRenamed("value", "version_a"), b.withColumnRenamed("value", "version_b")
    return left.join(right, "path", "full").where(~F.col("version_a").eqNullSafe(F.col("version_b")))


def flatten(settings: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, value as JSON) of the leaves of nested settings."""
    import json

    out: list[tuple[str, str]] = []
    for k, v in sorted(settings.items()):
        out += flatten(v, f"{prefix}{k}.") if isinstance(v, dict) and v else [(f"{prefix}{k}", json.dumps(v, sort_keys=True))]
    return out


def dataset_sets(versions: DataFrame) -> DataFrame:
    """versions (a, b: arrays) with common, only_a and only_b, each sorted."""
    each = {"common": F.array_intersect("a", "b"), "only_a": F.array_except("a", "b"), "only_b": F.array_except("b", "a")}
    return versions.select("*", *(F.array_sort(v).alias(k) for k, v in each.items()))


def changed_outputs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows whose candidates differ, matched by row key rather than by position."""
    both = a.join(b.select(key, F.col("candidate").alias("candidate_b")), key).withColumnRenamed("candidate", "candidate_a")
    return both.where(F.col("candidate_a") != F.col("candidate_b"))


def interpretation(deltas: dict[str, float], passed: bool) -> dict[str, object]:
    """Flags of a comparison; terminology is not judged and domains are never told apart."""
    formatting = [deltas.get(f"{m}_accuracy", 0.0) < 0 for m in ("placeholder", "markup", "punctuation")]
    return {
        "improved_overall": deltas.get("chrf", 0.0) > 0 and deltas.get("bleu", 0.0) >= 0,
        "regressed": not passed,
        "formatting_regression": reduce(lambda x, y: x or y, formatting),
        "terminology_regression": None,
        "domain_only_improvement": False,
    }


def manifest(experiments: DataFrame, versions: DataFrame, datasets: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """Experiments with their version, dataset manifest and tokenizer manifest; what is missing is null."""
    out = experiments.join(versions, "version_id", "left")
    return out.join(datasets, "dataset_version", "left").join(tokenizers, "tokenizer_version", "left")
