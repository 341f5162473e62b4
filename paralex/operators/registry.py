"""A registry of versions kept as a commit log.

A commit adds a table of versions (version_id, version_label, parent_version, status, protected, others), or changes
fields of single ones, and may name the version in production.  The registry is what replaying the commits gives: the
tables together, under the last value set for each field.  Writers race by commit number; one that loses decides again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.functions import text as T
from paralex.operators.tables import written
from paralex.sources.commits import Log

#: Fields that never change, the statuses that may be promoted, and those that may be gone back to.
IMMUTABLE = {"version_id", "version_label", "parent_version", "created_at", "language_pair", "direction", "tokenizer_version"}
PROMOTABLE = ("approved", "production")
RETURNABLE = ("approved", "production", "archived")


class RegistryError(ValueError):
    pass


def sorted_versions(versions: DataFrame) -> DataFrame:
    return versions.withColumn("number", T.semver(F.col("version_id"))).orderBy("number", "version_id")


def resolved(versions: DataFrame, requests: DataFrame, production: str | None) -> DataFrame:
    """requests (name) with version_id, or null: of `production` the id given, else an exact id, else a label that one
    version has."""
    wanted = requests.withColumn("wanted", F.when(F.col("name") == "production", F.lit(production)).otherwise(F.col("name")))
    labels = versions.groupBy("version_label").agg(F.count("*").alias("n"), F.min("version_id").alias("by_label")).where("n = 1")
    out = wanted.join(versions.select(F.col("version_id").alias("by_id")), F.col("wanted") == F.col("by_id"), "left")
    out = out.join(labels, F.col("wanted") == F.col("version_label"), "left")
    return out.select("name", F.coalesce("by_id", "by_label").alias("version_id"))


def free_labels(versions: DataFrame) -> DataFrame:
    """(parent, label) of the next free label below each major number, and (null, label) of the next major."""
    top = versions.select(T.semver(F.col("version_id")).alias("v")).groupBy("v.major").agg(F.max("v.minor").alias("minor"))
    minor = top.where("major IS NOT NULL").select(F.col("major").alias("parent"), F.format_string("v%d.%d.0", "major", F.col("minor") + 1).alias("label"))
    fresh = top.agg(F.format_string("v%d.0.0", F.coalesce(F.max("major"), F.lit(0)) + 1).alias("label"))
    return minor.unionByName(fresh.select(F.lit(None).cast("int").alias("parent"), "label"))


def ancestry(versions: DataFrame) -> DataFrame:
    """(version_id, ancestor, depth) of every version, itself at depth 0; chains are followed by doubling."""
    out = versions.select("version_id", F.col("version_id").alias("ancestor"), F.lit(0).alias("depth"))
    links = written(versions.where(F.col("parent_version").isNotNull()).select("version_id", F.col("parent_version").alias("ancestor")), "links")
    known = links.join(versions.select(F.col("version_id").alias("ancestor")), "ancestor", "left_semi").select("version_id", "ancestor")
    hop = 1
    while not known.isEmpty():
        on = known.select(F.col("version_id").alias("ancestor"), F.col("ancestor").alias("further"))
        out = written(out.unionByName(out.join(on, "ancestor").select("version_id", F.col("further").alias("ancestor"), (F.col("depth") + hop).alias("depth"))), "ancestors")
        known = written(known.join(on, "ancestor").select("version_id", F.col("further").alias("ancestor")), "links")
        hop *= 2
    return out


class Registry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder)

    def production(self, entries: list[dict] | None = None) -> str | None:
        named = [e["production"] for e in (self.log.entries() if entries is None else entries) if "production" in e]
        return named[-1] if named else None

    def versions(self, entries: list[dict] | None = None) -> DataFrame | None:
        """All versions as of the commits given (default: all); None before the first."""
        entries = self.log.entries() if entries is None else entries
        tables = [self.spark.read.parquet(f"{self.folder}/{e['table']}") for e in entries if "table" in e]
        if not tables:
            return None
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        changes = [(k, version, field, json.dumps(value)) for k, e in enumerate(entries) for version, fields in e.get("set", {}).items() for field, value in fields.items()]
        if not changes:
            return out
        rows = self.spark.createDataFrame(changes, "number int, version_id string, field string, value string")
        last = rows.groupBy("version_id").pivot("field", sorted({c[2] for c in changes})).agg(F.max_by("value", "number"))
        fields = [c for c in last.columns if c != "version_id"]
        last = last.withColumnsRenamed({c: f"__{c}" for c in fields})
        out = out.join(last, "version_id", "left")
        kinds = {f.name: f.dataType for f in out.schema}
        set_ = {c: F.when(F.col(f"__{c}").isNotNull(), F.from_json(F.concat(F.lit('{"v":'), f"__{c}", F.lit("}")), f"v {kinds[c].simpleString()}")["v"]).otherwise(F.col(c)) for c in fields}
        return out.withColumns(set_).drop(*(f"__{c}" for c in fields))

    def _row(self, entries: list[dict], version_id: str) -> dict:
        versions = self.versions(entries)
        row = versions.where(F.col("version_id") == version_id).first() if versions is not None else None
        if row is None:
            raise RegistryError(f"unknown version {version_id!r}")
        return row.asDict()

    def add(self, rows: DataFrame) -> None:
        """New versions, of any number; ids that exist, or come twice, are an error."""
        table = f"tables/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{table}")
        mine = self.spark.read.parquet(f"{self.folder}/{table}")

        def decide(entries: list[dict]) -> dict:
            versions = self.versions(entries)
            ids = mine.select("version_id") if versions is None else mine.select("version_id").unionByName(versions.select("version_id").join(mine, "version_id", "left_semi"))
            if not ids.groupBy("version_id").count().where("count > 1").isEmpty():
                raise RegistryError("a version exists")
            return {"op": "add", "table": table}

        self.log.commit(decide)

    def update(self, version_id: str, **changes: object) -> None:
        if fixed := IMMUTABLE & changes.keys():
            raise RegistryError(f"can't change {sorted(fixed)}")

        def decide(entries: list[dict]) -> dict:
            self._row(entries, version_id)
            return {"op": "update", "set": {version_id: changes}}

        self.log.commit(decide)

    def protect(self, version_id: str, protected: bool = True) -> None:
        self.update(version_id, protected=protected)

    def resolve(self, name: str, entries: list[dict] | None = None) -> str:
        """The id of `production`, of an exact id, or of a label that one version has."""
        entries = self.log.entries() if entries is None else entries
        versions = self.versions(entries)
        asked = self.spark.createDataFrame([(name,)], "name string")
        found = resolved(versions, asked, self.production(entries)).first()["version_id"] if versions is not None else None
        if found is None:
            raise RegistryError(f"unknown version {name!r}")
        return found

    def promote(self, version_id: str, override: bool = False) -> None:
        """Puts a version into production: it is protected, and the one before becomes approved."""

        def decide(entries: list[dict]) -> dict:
            status = self._row(entries, version_id)["status"]
            if status not in PROMOTABLE and not override:
                raise RegistryError(f"{version_id} is {status}")
            return self._promotion(version_id, entries, "promote")

        self.log.commit(decide)

    def rollback(self, name: str) -> None:
        """Goes back to a version that was in production, or may have been: protected, or of a status that allows it."""

        def decide(entries: list[dict]) -> dict:
            version_id = self.resolve(name, entries)
            row = self._row(entries, version_id)
            if row["status"] not in RETURNABLE and not row["protected"]:
                raise RegistryError(f"{version_id} can't be rolled back to")
            return self._promotion(version_id, entries, "rollback")

        self.log.commit(decide)

    def _promotion(self, version_id: str, entries: list[dict], op: str) -> dict:
        before = self.production(entries)
        changes = {version_id: {"status": "production", "protected": True}}
        if before not in (None, version_id):
            changes[before] = {"status": "approved"}
        return {"op": op, "set": changes, "production": version_id}
