"""Early stopping over a stream whose rows come late and out of order.

Rows of a run are numbered from 1.  A row that comes before one with a smaller number waits in the run's state until the
gap is filled.  Once the watermark passes the time of a row that waits, no row from before it can come any more: a timer
then gives up on the gaps below it, and the run goes on there.  State and timers are in the stream's checkpoint, so a
stream that was stopped goes on where it was.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, step long, best double, streak int, stopped boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]
#: A run's state is one value, read and written once a batch; waiting: rows of WAITING, timer: 0 if none is set.
STATE = "best double, streak int, stopped boolean, expected long, timer long, waiting binary"
WAITING = struct.Struct("<qqdq?")  # number, step, loss, time, whether the loss is null
#: The state store that states with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stopping(StatefulProcessor):
    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _go_on(self, run: str, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Takes rows (number, step, loss, time) as long as their numbers follow, and lets the rest wait."""
        best, streak, stopped, expected, timer, waiting = self.state.get() or (float("inf"), 0, False, 1, 0, b"")
        before = [(n, s, None if null else x, t) for n, s, x, t, null in WAITING.iter_unpack(bytes(waiting))]
        rows = sorted({r[0]: r for r in [*new, *before]}.values(), key=lambda r: r[0])  # of repeats, the first to come
        sure = max((r[0] for r in rows if r[3] < watermark), default=0)  # gaps below this stay open
        out, left = [], []
        for number, step, loss, time in rows:
            if number > expected and number > sure:
                left.append((number, step, loss, time))
            elif number >= expected:
                expected = number + 1
                if not stopped and loss is not None:
                    best, streak = (loss, 0) if loss < best else (best, streak + 1)
                    stopped = streak >= self.patience
                out.append((run, step, float(best), int(streak), bool(stopped)))
        due = min((r[3] for r in left), default=-1) + 1
        if due != timer:
            if timer > watermark:  # an earlier one has expired
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        waiting = b"".join(WAITING.pack(n, s, 0.0 if x is None else x, t, x is None) for n, s, x, t in left)
        self.state.update((float(best), int(streak), bool(stopped), int(expected), int(due), waiting))
        if out:
            yield pd.DataFrame(dict(zip(NAMES, zip(*out), strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            times = batch["timestamp"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            losses = (None if x != x else x for x in batch["loss"].to_numpy(float, na_value=float("nan")).tolist())
            new += zip(batch["number"].tolist(), batch["step"].tolist(), losses, times, strict=True)
        yield from self._go_on(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """Sets the state store that these streams need; to be called before one starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def early_stopping_late(events: DataFrame, patience: int, late: str) -> DataFrame:
    """OUT for each event (run, number, step, loss, timestamp) in the order of its number: the run's best loss, the
    streak without improvement and whether it stopped, after which the state stays.

    late: how far behind the newest row others may come.  A number that was taken or given up on before is dropped, so
    repeats do no harm.  Null losses change nothing."""
    marked = events.withWatermark("timestamp", late)
    return marked.groupBy("run").transformWithStateInPandas(Stopping(patience), OUT, "append", "eventTime")
