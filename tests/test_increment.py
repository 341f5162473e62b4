"""Batches that come one by one, and batches that come twice."""

import random

import pytest

from paralex.operators import increment, validate
from paralex.streaming.sink import EventSink


def test_batches_are_judged_as_if_at_once(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"s{rng.randrange(60)}", rng.choice(["", f"t{rng.randrange(60)}", f"t{rng.randrange(60)}"])) for k in range(300)]
    table = spark.createDataFrame(rows, "ord long, source string, target string")
    rules = validate.Rules()
    past = increment.Accepted(spark, str(tmp_path / "accepted"))
    got = []
    for lo, hi in ((0, 120), (120, 120), (120, 121), (121, 300)):
        got += past.take(table.where(f"ord >= {lo} AND ord < {hi}"), rules).select("ord", "reasons").collect()
    assert sorted(got) == sorted(validate.validate(table, rules).select("ord", "reasons").collect())
    assert past.digests().count() == sum(not r["reasons"] for r in got)
    with pytest.raises(ValueError):
        past.take(table.where("ord = 5"), rules)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    sink = EventSink(spark, str(tmp_path / "sink"))
    batch = lambda rows: spark.createDataFrame(rows, "run string, step long, event string")
    assert sink.write(batch([("a", 1, "x"), ("b", 5, "y")]), 0)
    assert sink.write(batch([("a", 2, "z"), ("b", 4, "late"), ("c", 1, "new")]), 1)
    before = sorted(map(tuple, sink.last().collect()))
    assert before == [("a", 2, "z"), ("b", 5, "y"), ("c", 1, "new")]
    assert not sink.write(batch([("a", 9, "again")]), 0) and not sink.write(batch([("a", 9, "again")]), 1)
    assert sorted(map(tuple, sink.last().collect())) == before and sink.events().count() == 5


def test_a_stream_is_taken_up_again(spark, tmp_path):
    """Files that come after a stop go on where it stopped, and a second run over nothing new adds nothing."""
    from paralex.streaming import events

    (tmp_path / "log").mkdir()
    sink = EventSink(spark, str(tmp_path / "sink"))
    for k in range(3):
        if k < 2:
            (tmp_path / "log" / f"{k}.jsonl").write_text("".join(f'{{"run": "r{j}", "step": {10 * k + j}, "event": "e"}}\n' for j in range(3)), "utf-8")
        sink.start(events.tail(spark, str(tmp_path / "log")).select("run", "step", "event"), availableNow=True).awaitTermination()
    assert sink.events().count() == 6 and sorted((r["run"], r["step"]) for r in sink.last().collect()) == [("r0", 10), ("r1", 11), ("r2", 12)]
