"""Sinks: deterministic JSON Lines, versioned datasets, documents, and event logs."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paralex.operators.tables import written
from paralex.sources import commits
from paralex.sources.readers import numbered_lines


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as an object with its keys in order, nulls kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def interleaved(records: DataFrame, *order: str, side: str | None = None) -> DataFrame:
    """Tokenizer corpus lines (value): one side, or source, target, source, target."""
    sides = F.array(side) if side else F.array("source", "target")
    return records.select(*order, F.posexplode(sides).alias("side", "value")).orderBy(*order, "side").select("value")


def write_lines(rows: DataFrame, path: str, order: str, value: str) -> None:
    """A folder of text files that follow by name: each row's value as one line, in order."""
    rows.select(order, value).orderBy(order).select(value).write.mode("overwrite").text(path)


def file_hashes(spark: SparkSession, root: str, inputs: list[str]) -> dict[str, str]:
    """A digest of each input's numbered lines, in one job over all inputs; no file is a cell or a task of its own."""
    files = [numbered_lines(spark, f"{root}/{p}").withColumn("path", F.lit(p)) for p in inputs]
    found = _digests(reduce(DataFrame.unionByName, files), "path", F.struct("row_number", "line"))
    return {p: hashlib.sha256(b"").hexdigest() for p in inputs} | {r["path"]: r["digest"] for r in found.collect()}


def _digests(rows: DataFrame, by: str, cells: Column) -> DataFrame:
    """(by, rows, digest): of each group a digest that doesn't depend on the rows' order, made of their number and of the
    sums of their SHA-256, in four parts.  A row's covers its cells by name and tells nulls from texts."""
    each = F.sha2(F.to_json(cells, {"ignoreNullFields": "false"}), 256)
    parts = rows.select(by, *(F.conv(F.substring(each, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(4)))
    sums = parts.groupBy(by).agg(F.count("*").alias("rows"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(4)))
    return sums.select(by, "rows", F.sha2(F.concat_ws(":", "rows", *(F.col(f"p{k}").cast("string") for k in range(4))), 256).alias("digest"))


def fingerprint(hashes: dict[str, str], config: dict) -> str:
    """Sixteen hex digits that the inputs' paths and bytes and the configuration determine."""
    document = {"config": config, "files": [[p, hashes[p]] for p in sorted(hashes)], "schema": 1}
    return hashlib.sha256(json.dumps(document, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def write_dataset(accepted: DataFrame, rejected: DataFrame, report: dict, root: str, version: str, manifest: dict) -> str:
    """An immutable version: processed rows by split, rejected rows, the report, and the manifest; the pointer comes last.

    A version whose manifest exists is left as it is; of writers of one version, the first manifest counts."""
    spark = accepted.sparkSession
    base = f"{root}/versions/{version}"
    if not commits.exists(spark, f"{base}/manifest.json"):
        accepted.write.mode("overwrite").partitionBy("split").parquet(f"{base}/processed")
        rejected.write.mode("overwrite").parquet(f"{base}/rejected")
        write_document(spark, f"{base}/report.json", report)
        commits.put_new(spark, f"{base}/manifest.json", _pretty({**manifest, "version": version, "report": report}))
    write_document(spark, f"{root}/current.json", {"dataset_version": version, "manifest": f"versions/{version}/manifest.json"})
    return base


def _pretty(document: object) -> str:
    return json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False)


def write_document(spark: SparkSession, path: str, document: object) -> None:
    """Sorted JSON, put in place whole, in any store that Spark reads."""
    commits.put(spark, path, _pretty(document))


def digest_tree(rows: DataFrame, key: str, leaves: int) -> DataFrame:
    """(leaf, rows, digest): rows by ranges of a hash of the key, each with the digest of its rows, whatever their order."""
    leaf = F.pmod(F.xxhash64(key), F.lit(leaves)).cast("long")
    return _digests(rows.withColumn("leaf", leaf), "leaf", F.struct(*sorted(rows.columns)))


def parent_level(level: DataFrame, fan: int) -> DataFrame:
    """The level of a digest tree above one: each node has `fan` children, found by their numbers."""
    children = F.array_sort(F.collect_list(F.struct("leaf", "digest")))
    above = level.withColumn("up", F.floor(F.col("leaf") / fan)).groupBy("up").agg(F.sum("rows").alias("rows"), children.alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["leaf"], x["digest"])), ",")
    return above.select(F.col("up").alias("leaf"), "rows", F.sha2(text, 256).alias("digest"))


def write_tree(rows: DataFrame, key: str, path: str, leaves: int = 4096, fan: int = 64) -> str:
    """Writes rows by the leaves of their digest tree, and its levels; returns the root's digest, which equal rows share
    whatever their order and files."""
    spark = rows.sparkSession
    leaf = F.pmod(F.xxhash64(key), F.lit(leaves)).cast("long")
    group = F.floor(leaf / fan)
    rows.withColumn("__leaf", leaf).withColumn("__group", group).repartitionByRange("__group", "__leaf", key).sortWithinPartitions("__group", "__leaf").write.partitionBy("__group").parquet(f"{path}/rows")
    level = written(digest_tree(spark.read.schema(rows.schema).parquet(f"{path}/rows").select(rows.columns), key, leaves), "tree")
    depth, width = 0, leaves
    while True:
        level.coalesce(1).write.parquet(f"{path}/level={depth}")
        if width <= 1:
            break
        level, width, depth = written(parent_level(level, fan), "tree"), -(-width // fan), depth + 1
    held = rows.schema.add("__leaf", "long").add("__group", "long")
    write_document(spark, f"{path}/tree.json", {"key": key, "leaves": leaves, "fan": fan, "depth": depth, "schema": held.jsonValue()})
    root = level.first()
    return root["digest"] if root else hashlib.sha256(b"").hexdigest()


def tree_difference(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(key, change) of the rows that two versions written by write_tree() don't share: added, removed or changed.

    Their trees are compared from the root down: a node is looked at only below nodes that differ, and rows are read
    only from ranges whose leaves do.  Rows that share a key are compared as one."""
    plans = [json.loads(commits.read(spark, f"{p}/tree.json")) for p in (old, new)]
    if plans[0] != plans[1]:
        raise ValueError("trees of different shapes can't be compared")
    plan, unequal = plans[0], None
    for depth in reversed(range(plan["depth"] + 1)):
        a, b = (spark.read.parquet(f"{p}/level={depth}").select("leaf", F.col("digest").alias(n)) for p, n in ((old, "was"), (new, "now")))
        if unequal is not None:
            up = unequal.select(F.col("leaf").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("leaf") / plan["fan"])).join(up, "up", "left_semi").drop("up") for x in (a, b))
        unequal = written(a.join(b, "leaf", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("leaf"), "unequal")
    groups = [r["g"] for r in unequal.select(F.floor(F.col("leaf") / plan["fan"]).alias("g")).distinct().collect()]  # leaves / fan at most
    key, sides = plan["key"], []
    for path, name in ((old, "was"), (new, "now")):
        rows = spark.read.schema(StructType.fromJson(plan["schema"])).parquet(f"{path}/rows").where(F.col("__group").isin(groups))  # folders that are not read
        rows = rows.join(unequal, rows["__leaf"] == unequal["leaf"], "left_semi").drop("__leaf", "__group")
        cells = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
        sides.append(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.sha2(cells, 256))).alias(name)))
    both = sides[0].join(sides[1], key, "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))
