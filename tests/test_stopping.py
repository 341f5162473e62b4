"""Early stopping over rows that come late, in any order, and over a stream that is stopped in between."""

import json
import random

from paralex.streaming import events, stopping

SCHEMA = "run string, number long, step long, event string, loss double, timestamp timestamp"


def line(run, number, loss):
    return json.dumps({"run": run, "number": number, "step": 10 * number, "event": "e", "loss": loss, "timestamp": f"2024-01-01T00:{number:02}:00Z"})


def fold(losses, patience):
    best, streak, stopped, out = float("inf"), 0, False, []
    for number, loss in losses:
        if not stopped and loss is not None:
            best, streak = (loss, 0) if loss < best else (best, streak + 1)
            stopped = streak >= patience
        out.append((10 * number, best, streak, stopped))
    return out


def run(spark, tmp_path, files, late):
    """Each list of lines is a file, and a stream of its own over what is new."""
    stopping.stateful(spark)
    (tmp_path / "log").mkdir()
    for k, lines in enumerate(files):
        (tmp_path / "log" / f"{k}.jsonl").write_text("\n".join(lines) + "\n", "utf-8")
        stops = stopping.early_stopping_late(events.tail(spark, str(tmp_path / "log"), SCHEMA), 3, late)
        stops.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.schema(stops.schema).parquet(str(tmp_path / "out")).collect()
    return {name: sorted((r["step"], r["best"], r["streak"], r["stopped"]) for r in rows if r["run"] == name) for name in {r["run"] for r in rows}}


def test_any_order_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(1)
    runs = {name: [(k, rng.choice([None, float(rng.randrange(30))])) for k in range(1, 40)] for name in "abc"}
    lines = [line(name, k, loss) for name, losses in runs.items() for k, loss in losses]
    lines += lines[:7]  # repeats
    rng.shuffle(lines)
    got = run(spark, tmp_path, [lines[:30], lines[30:90], lines[90:]], "2 hours")
    assert got == {name: fold(losses, 3) for name, losses in runs.items()}


def test_gaps_are_given_up_when_the_watermark_passes(spark, tmp_path):
    """Number 2 never comes: 3 waits until rows of another run are ten minutes further on."""
    first = [line("a", 1, 5.0), line("a", 3, 4.0), line("a", 4, 6.0), line("b", 1, 1.0)]
    got = run(spark, tmp_path, [first, [line("b", 2, 2.0)], [line("b", 3, 2.0), line("b", 50, 2.0)], [line("a", 51, 1.0)]], "10 minutes")
    assert got["a"] == [(10, 5.0, 0, False), (30, 4.0, 0, False), (40, 4.0, 1, False)]
    assert got["b"] == [(10, 1.0, 0, False), (20, 1.0, 1, False), (30, 1.0, 2, False)]


class Handle:
    """A state's variables and timers, with the number of calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        raise AssertionError("a second variable: its own round trips for every run and batch")

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_batch_asks_the_state_once(spark):
    """Without gaps one read and one write; a timer is moved only when the first row that waits changes."""
    handle, stops = Handle(), stopping.Stopping(3)
    stops.init(handle)
    step = lambda *new, watermark=0: [tuple(r) for x in stops._go_on("a", list(new), watermark) for r in x.itertuples(index=False)]
    assert len(step((1, 10, 5.0, 100), (2, 20, None, 200))) == 2 and handle.calls == 2
    assert step((4, 40, 4.0, 400)) == [] and handle.timers == {401}
    calls = handle.calls
    assert step((5, 50, None, 500)) == [] and handle.calls == calls + 2
    assert step((3, 30, 6.0, 300)) == [("a", 30, 5.0, 1, False), ("a", 40, 4.0, 0, False), ("a", 50, 4.0, 0, False)] and handle.timers == set()
