"""A sink that takes every micro-batch of a stream once, and keeps each run's last event.

A batch's rows are written to a folder of their own, then one commit names the folder, the batch and the new table of
last events.  A batch that comes again, since a stream was restarted or replayed, finds its number in the log and leaves
everything as it is; what a lost attempt wrote is in no commit.  The table of last events is made of the one before and
the batch, never of the whole log.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paralex.operators import monitor
from paralex.sources.commits import Log


class EventSink:
    def __init__(self, spark: SparkSession, folder: str, run: str = "run", order: str = "step"):
        self.spark, self.folder, self.run, self.order = spark, folder.rstrip("/"), run, order
        self.log = Log(spark, folder)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, batch: DataFrame, number: int) -> bool:
        """Takes a batch under its number; False if that was taken before.  For foreachBatch."""
        if any(e["batch"] == number for e in self.log.entries()):
            return False
        name = f"batches/{number}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.folder}/{name}")
        rows = self._read(name)

        def decide(entries: list[dict]) -> dict | None:
            if any(e["batch"] == number for e in entries):
                return None
            last = monitor.latest(rows, self.run, self.order)
            if entries:
                last = monitor.latest(self._read(entries[-1]["last"]).unionByName(last), self.run, self.order)
            table = f"last/{number}-{uuid.uuid4().hex}"
            last.write.parquet(f"{self.folder}/{table}")
            return {"batch": number, "rows": name, "last": table}

        before = self.log.length()
        return self.log.commit(decide) > before

    def start(self, events: DataFrame, **trigger: object) -> StreamingQuery:
        """Runs a stream of events into the sink; its checkpoint lies in the sink's folder."""
        stream = events.writeStream.foreachBatch(lambda batch, number: self.write(batch, number) and None)
        return stream.option("checkpointLocation", f"{self.folder}/state").trigger(**trigger).start()

    def events(self) -> DataFrame:
        """All events taken; there must be some batch."""
        return reduce(DataFrame.unionByName, (self._read(e["rows"]) for e in self.log.entries()))

    def last(self) -> DataFrame:
        """Each run's last event."""
        return self._read(self.log.entries()[-1]["last"])
