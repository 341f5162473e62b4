"""The event log as a stream: tailing, summaries by event time, and early stopping with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "run string, step long, event string, loss double, timestamp timestamp"
STATE = "best double, streak int, stopped boolean"
OUT = "run string, step long, best double, streak int, stopped boolean"


def tail(spark: SparkSession, folder: str, schema: str = EVENT, **options: object) -> DataFrame:
    """Whole JSON objects of the files that arrive; partial lines and other values are skipped."""
    lines = spark.readStream.options(**options).text(folder)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).where(F.col("e.event").isNotNull()).select("e.*")


def windowed(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean loss by event type in windows of event time (an addition to the reference's operators)."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "event").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"))


def early_stopping(events: DataFrame, patience: int) -> DataFrame:
    """OUT for each event of a run in step order: its best loss, the streak without improvement, and whether it stopped.

    Rows of a batch are taken in order of step; steps are expected to rise from batch to batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, streak, stopped = state.get if state.exists else (float("inf"), 0, False)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for number, loss in zip(rows["step"], rows["loss"], strict=True):
            if not stopped and loss == loss:
                best, streak = (loss, 0) if loss < best else (best, streak + 1)
                stopped = streak >= patience
            out.append((key[0], int(number), float(best), int(streak), bool(stopped)))
        state.update((float(best), int(streak), bool(stopped)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("run").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
