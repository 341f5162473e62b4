"""Evaluation of predictions, and the comparison of two versions on the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.operators import compare, metrics


def evaluate(rows: DataFrame) -> dict[str, float]:
    """All metrics of rows (source, reference, candidate); there must be some."""
    means = metrics.text_metrics(rows).first().asDict()
    if not means["sentence_count"]:
        raise ValueError("nothing to evaluate")
    return {
        "bleu": metrics.bleu_score(metrics.bleu_statistics(rows)),
        "chrf": metrics.chrf_score(metrics.chrf_statistics(rows)),
        "ter": float(metrics.ter(rows).first()["ter"]),
        **{k: float(v) for k, v in means.items()},
    }


def tidy(spark: SparkSession, scores: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(scores.items()), "metric string, value double")


def compare_versions(a: DataFrame, b: DataFrame, limits: dict[str, float], key: str = "row_id", sample: int = 20) -> dict[str, object]:
    """Scores of both (a: baseline), deltas, gates, flags, the number of changed outputs, and the first changed rows by
    key.  Rows are matched by key, so a version that dropped a row is compared on what both have."""
    spark = a.sparkSession
    shared = a.select(key).join(b.select(key), key)
    scores = [evaluate(x.join(shared, key, "left_semi")) for x in (a, b)]
    deltas = {r["metric"]: r["delta"] for r in compare.metric_deltas(*(tidy(spark, s) for s in scores)).collect()}
    checks = compare.gates(*(tidy(spark, s) for s in scores), limits)
    passed = compare.all_passed(checks).first()["passed"]
    changed = compare.changed_outputs(a, b.select(key, "candidate"), key)
    return {
        "metrics": {"a": scores[0], "b": scores[1], "deltas": deltas},
        "gates": {"passed": passed, "checks": [r.asDict() for r in checks.collect()]},
        "interpretation": compare.interpretation(deltas, passed),
        "changed": changed.count(),
        "samples": [r.asDict() for r in changed.orderBy(key).limit(sample).collect()],
    }


def find_version(registries: list[DataFrame], name: str) -> str:
    """The id that a version id or label means over several registries; it must be one."""
    rows = reduce(DataFrame.unionByName, (r.select("version_id", "version_label") for r in registries))
    found = rows.where((F.col("version_id") == name) | (F.col("version_label") == name)).select("version_id").distinct().limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{name!r} means {'several versions' if found else 'no version'}")
    return found[0]["version_id"]
