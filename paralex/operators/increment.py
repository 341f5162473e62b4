"""Incoming records judged as an increment: against what was accepted before, and among themselves.

The past is a table of digests of accepted pairs, a part of it for each commit.  A batch takes what rebuilding from all
records would give it, as long as batches come in the order of their records; its texts are read, those of the past
aren't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.operators import validate
from paralex.sources.commits import Log


class Accepted:
    """The digests (ord, s, t) of accepted pairs, below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder)

    def digests(self, entries: list[dict] | None = None) -> DataFrame | None:
        entries = self.log.entries() if entries is None else entries
        return self.spark.read.schema("ord long, s binary, t binary").parquet(*(f"{self.folder}/{e['table']}" for e in entries)) if entries else None

    def take(self, records: DataFrame, rules: validate.Rules) -> DataFrame:
        """records (ord, source, target, others) with reasons, as validate() gives them; those accepted become part of
        the past.  An ord not above all of the past is an error: such a batch needs a rebuild."""
        judged: list[DataFrame] = []

        def decide(entries: list[dict]) -> dict:
            past = self.digests(entries)
            low, top = records.agg(F.min("ord"), F.max("ord")).first()
            if entries and low is not None and low <= max(e["last"] for e in entries):
                raise ValueError("records that come before accepted ones need a rebuild")
            rows, fresh = validate.judge(records, rules, past)
            table = f"accepted/{uuid.uuid4().hex}"
            fresh.write.parquet(f"{self.folder}/{table}")
            judged[:] = [rows]
            return {"table": table, "last": max([-1 if top is None else top, *(e["last"] for e in entries)])}

        self.log.commit(decide)
        return judged[0]
