"""Commands over a dataset folder: `python -m paralex.cli dataset validate|prepare ROOT`, `events EVENTS`."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.functions import text as T
from paralex.operators import monitor, validate
from paralex.sources import readers, sinks
from paralex.streaming.events import EVENT


def load(spark: SparkSession, root: str, inputs: list[str]) -> DataFrame:
    """All records, normalised, in their total order."""
    rows = readers.read_all(spark, root, inputs)
    rows = rows.withColumns({s: T.normalize_text(F.col(s)) for s in ("source", "target")})
    return rows.withColumn("ord", F.shiftleft(F.col("file_ord").cast("long"), 40) + F.col("row_number"))


def prepare(spark: SparkSession, root: str, rules: validate.Rules, split: dict, write: bool = True) -> dict:
    """Validates the inputs below root and, if asked, writes the version that they and the settings determine."""
    inputs = readers.discover_inputs(spark, root)
    judged = validate.validate(load(spark, root, inputs), rules).cache()
    report = {**validate.report(judged).first().asDict(), "input_files": inputs}
    if write:
        settings = {"rules": vars(rules), "split": split}
        version = sinks.fingerprint(sinks.file_hashes(spark, root, inputs), settings)
        accepted = validate.split(judged.where(F.size("reasons") == 0), **split).drop("reasons")
        report["dataset_version"] = version
        sinks.write_dataset(accepted, judged.where(F.size("reasons") > 0), report, f"{root}/prepared", version, {"config": settings, "inputs": inputs})
    judged.unpersist()
    return report


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="paralex")
    commands = parser.add_subparsers(dest="command", required=True)
    dataset = commands.add_parser("dataset")
    dataset.add_argument("action", choices=["validate", "prepare"])
    dataset.add_argument("root")
    dataset.add_argument("--maximum-ratio", type=float, default=3.0)
    dataset.add_argument("--train", type=float, default=0.9)
    dataset.add_argument("--validation", type=float, default=0.05)
    dataset.add_argument("--seed", type=int, default=42)
    log = commands.add_parser("events")
    log.add_argument("path")
    options = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if options.command == "dataset":
        split = {"train": options.train, "validation": options.validation, "seed": options.seed}
        out: object = prepare(spark, options.root, validate.Rules(maximum_ratio=options.maximum_ratio), split, options.action == "prepare")
    else:
        rows = monitor.latest(readers.read_events(spark, options.path, EVENT), "run", "step")
        out = [json.loads(x) for x in rows.toJSON().collect()]
    print(json.dumps(out, sort_keys=True, indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
