"""Strict readers of aligned text, TSV, CSV and JSON Lines, with file order and row numbers.

All are read and numbered block by block, so a file of any size is spread over tasks; in TSV and CSV, blocks are told
whether they begin inside a quoted cell.  Every reader gives RECORD; file_ord and row_number make the total order.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.operators.replay import numbered
from paralex.operators.tables import written

RECORD = "source string, target string, origin string, row_number long, domain string, metadata string, file_ord int"
#: Those among them that do not end a line of a text file.
INNER_ENDS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


class DatasetFormatError(ValueError):
    pass


class DatasetAlignmentError(DatasetFormatError):
    pass


def _list(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder of any store that Spark reads; none where it is missing."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []


def discover_inputs(spark: SparkSession, root: str, include_incoming: bool = True) -> list[str]:
    """Inputs in order, relative to root: in raw/ and then incoming/, the text pair, then *.tsv, *.csv, *.jsonl by name."""
    out: list[str] = []
    for folder in ["raw", *["incoming"] * include_incoming]:
        names = _list(spark, f"{root}/{folder}")
        if ("source.txt" in names) != ("target.txt" in names):
            raise DatasetFormatError(f"{folder}: one of source.txt and target.txt is missing")
        wanted = [n for n in ("source.txt", "target.txt") if n in names]
        for suffix in (".tsv", ".csv", ".jsonl"):
            wanted += [n for n in names if n.endswith(suffix)]
        out += [f"{folder}/{n}" for n in wanted]
    if not out:
        raise FileNotFoundError(f"{root}: nothing to read in raw or incoming")
    return out


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row (text) of a file; bytes that are not UTF-8 are an error that names the file."""
    raw = spark.read.format("binaryFile").load(path)
    sound = F.assert_true(F.is_valid_utf8(F.col("content").cast("string")), F.concat(F.lit("not UTF-8: "), F.col("path")))
    return raw.select(F.col("content").cast("string").alias("text"), sound.alias("sound")).where(F.col("sound").isNull()).select("text")


def _edges(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a file (the first one of a folder) begins with a byte order mark, and whether its (the last one's) last
    character is one of INNER_ENDS."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = [path] if fs.getFileStatus(hadoop(path)).isFile() else [f"{path}/{n}" for n in _list(spark, path) if n[0] not in "._"]
    if not files:
        return False, False

    def read(name: str, last: bool) -> bytes:
        size = fs.getFileStatus(hadoop(name)).getLen()
        stream = fs.open(hadoop(name))
        try:
            stream.seek(max(0, size - 3) if last else 0)
            return bytes(stream.read() for _ in range(min(3, size)))
        finally:
            stream.close()

    end = read(files[-1], True).decode("utf-8", "ignore")
    return read(files[0], False) == b"\xef\xbb\xbf", bool(re.search(INNER_ENDS + r"\Z", end))


def numbered_lines(spark: SparkSession, path: str, block: bool = False) -> DataFrame:
    """(row_number, line): lines as Python's str.splitlines gives them, from 1.  A folder's files follow by name.
    block: with the file and place of the block that a line was read from (f, b).

    Lines are numbered within their block and blocks by their counts, so no task sees the whole file.  Bytes that are not
    UTF-8 are an error that names the file."""
    marked, ends_inside = _edges(spark, path)
    sound = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("_metadata.file_path"))))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), sound.alias("value"))
    lines = raw.select("f", "b", "i", F.posexplode(F.split("value", INNER_ENDS)).alias("k", "line"))
    sizes = lines.groupBy("f", "b").agg(F.count("*").alias("size"))  # a row a block
    before = F.coalesce(F.sum("size").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("f", "b", before.alias("before"), F.sum("size").over(W.partitionBy()).alias("total"))
    place = F.row_number().over(W.partitionBy("f", "b").orderBy("i", "k")) + F.col("before")
    out = lines.join(starts, ["f", "b"]).select("f", "b", place.cast("long").alias("row_number"), "line", "total")
    if ends_inside:  # what follows the last line end is no line
        out = out.where("row_number < total")
    if marked:
        out = out.withColumn("line", F.when(F.col("row_number") == 1, F.concat(F.lit("\ufeff"), F.ltrim("line", F.lit("\ufeff")))).otherwise(F.col("line")))
    return out.select("f", "b", "row_number", "line") if block else out.select("row_number", "line")


def read_parallel_text(spark: SparkSession, root: str, source: str, target: str, file_ord: int = 0) -> DataFrame:
    """Line-aligned files, numbered from 1; unequal counts are an error."""
    left, right = (numbered_lines(spark, f"{root}/{p}").withColumnRenamed("line", n) for p, n in ((source, "source"), (target, "target")))
    a, b = left.count(), right.count()
    if a != b:
        raise DatasetAlignmentError(f"lines don't align: {a} in {source}, {b} in {target}")
    nothing = F.lit(None).cast("string")
    return left.join(right, "row_number").select("source", "target", F.lit(f"{source} + {target}").alias("origin"), "row_number", nothing.alias("domain"), nothing.alias("metadata"), F.lit(file_ord).alias("file_ord"))


def _quoted_at_end(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open behind a line, if one is open before it or not.

    A quote opens a cell only where the cell begins; inside, two quotes are a character and one ends the quoting, after
    which the cell goes on as a plain one."""
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        if inside:
            end = line.find('"', at)
            while end >= 0 and line.startswith('""', end):
                end = line.find('"', end + 2)
            if end < 0:
                return True
            inside, at = False, end + 1
        at = line.find(delimiter, at) + 1  # quotes in the rest of a cell mean nothing
        if not at:
            return False


def quoted_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(number, text): the records of a delimited file in order, from 1; the lines of one that has a line end in a quoted
    cell are put together without it.

    Whether a line begins inside a quoted cell depends on all before it, yet each line is one of few maps from "inside
    or not" before it to after it, and lines without a quote leave things as they are.  Maps are composed within blocks
    of the file, blocks in order of their place, so every block is read by its own task and then told how it began.
    Only records of several lines are brought together.
    """

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, inside in (("from_out", False), ("from_in", True)):
                batch[name] = [_quoted_at_end(x, inside, delimiter) for x in batch["line"]]
            yield batch[["row_number", "from_out", "from_in"]]

    lines = numbered_lines(spark, path, block=True)
    told = lines.where(F.contains("line", F.lit('"'))).select("row_number", "line").mapInPandas(maps, "row_number long, from_out boolean, from_in boolean")
    lines = lines.join(told, "row_number", "left").withColumns({"from_out": F.coalesce("from_out", F.lit(False)), "from_in": F.coalesce("from_in", F.lit(True))})
    # of a map that gives one result whatever came before: its result; else how often it was turned round since
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    turned = (F.col("from_out") & ~F.col("from_in")).cast("int")
    lines = written(lines.withColumns({"fixed": fixed, "turned": turned}).drop("from_out", "from_in"), "lines")

    def after(rows: DataFrame, by: W, suffix: str) -> DataFrame:
        """rows with fixed_<suffix>, the state after a row where it is known, and turned_<suffix>, the turns since."""
        turns = F.sum("turned").over(by)
        rows = rows.withColumn("__turns", turns)
        last = F.max_by(F.struct("fixed", "__turns"), F.when(F.col("fixed").isNotNull(), F.col("row_number"))).over(by)
        rows = rows.withColumn("__last", last)
        return rows.withColumns({f"fixed_{suffix}": F.col("__last.fixed"), f"turned_{suffix}": F.col("__turns") - F.coalesce("__last.__turns", F.lit(0))}).drop("__turns", "__last")

    inside = W.partitionBy("f", "b").orderBy("row_number").rowsBetween(W.unboundedPreceding, 0)
    rows = after(lines, inside, "here")
    # a row a block: what the block does to the state, and then the state that each begins with
    whole = rows.groupBy("f", "b").agg(F.max_by(F.struct(F.col("fixed_here").alias("fixed"), F.col("turned_here").alias("turned")), "row_number").alias("m"), F.min("row_number").alias("row_number"))
    ends = F.col("m.fixed") != (F.col("m.turned") % 2 == 1)
    turned = F.when(ends.isNull(), F.col("m.turned")).otherwise(0)
    blocks = after(whole.select("f", "b", "row_number", ends.alias("fixed"), turned.alias("turned")), W.orderBy("row_number").rowsBetween(W.unboundedPreceding, 0), "block")
    state = F.coalesce(F.col("fixed_block"), F.lit(False)) != (F.col("turned_block") % 2 == 1)
    begins = blocks.select("f", "b", F.lag(state, 1, False).over(W.orderBy("row_number")).alias("began"))
    rows = rows.join(begins, ["f", "b"])
    ends_in = F.coalesce(F.col("fixed_here"), F.col("began")) != (F.col("turned_here") % 2 == 1)
    rows = rows.withColumn("open", ends_in).withColumn("starts", ~F.lag("open").over(W.partitionBy("f", "b").orderBy("row_number")))
    rows = rows.withColumn("starts", F.coalesce("starts", ~F.col("began")))
    # records are numbered as lines are: within blocks, after the blocks before
    sizes = rows.groupBy("f", "b").agg(F.count_if("starts").alias("records"), F.min("row_number").alias("first"))
    before = F.coalesce(F.sum("records").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("nth", F.sum(F.col("starts").cast("long")).over(inside)).join(sizes.select("f", "b", before.alias("before")), ["f", "b"])
    rows = written(rows.select((F.col("nth") + F.col("before")).alias("number"), "row_number", "line", (F.col("starts") & ~F.col("open")).alias("alone")), "records")
    pieces = rows.where(~F.col("alone")).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("row_number", "line"))).alias("l"))
    joined = pieces.select("number", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))
    return rows.where("alone").select("number", F.col("line").alias("text")).unionByName(joined)


def _cells(records: DataFrame, delimiter: str) -> DataFrame:
    """records (number, text) with cells: none of an empty text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cells"] = [next(csv.reader([x], delimiter=delimiter), []) for x in batch["text"]]
            yield batch[["number", "cells"]]

    return records.mapInPandas(cut, "number long, cells array<string>")


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def read_tsv(spark: SparkSession, root: str, path: str, file_ord: int = 0) -> DataFrame:
    """Two or more columns, the third a domain; a header counts as row 1; a blank line is a row of empty texts."""
    rows = _cells(quoted_records(spark, f"{root}/{path}", "\t"), "\t")
    cell = lambda k: F.get("cells", F.lit(k))
    header = (F.col("number") == 1) & (F.size("cells") > 1) & cell(0).isin("source", "source_text")
    nothing = F.lit(None).cast("string")
    return rows.where(~header).select(_blank(cell(0)).alias("source"), _blank(cell(1)).alias("target"), F.lit(path).alias("origin"), F.col("number").alias("row_number"), F.nullif(cell(2), F.lit("")).alias("domain"), nothing.alias("metadata"), F.lit(file_ord).alias("file_ord"))


#: The columns of a CSV file that are not its metadata.
OWN_COLUMNS = ["source_text", "target_text", "domain"]


def read_csv(spark: SparkSession, root: str, path: str, file_ord: int = 0) -> DataFrame:
    """Columns source_text and target_text, maybe domain; others go to metadata, cells without a header under "None".
    Rows are numbered from 2, blank lines left out; of columns with one name the last counts."""
    rows = written(_cells(quoted_records(spark, f"{root}/{path}", ","), ","), "cells")
    first = rows.where("number = 1").first()
    header = list(first["cells"]) if first else []
    if not set(OWN_COLUMNS[:2]) <= set(header):
        raise DatasetFormatError(f"{path}: headers source_text and target_text are needed, not {header}")
    place = {name: k for k, name in enumerate(header)}
    rows = rows.where((F.col("number") > 1) & (F.size("cells") > 0))
    filled = numbered(rows, "number")
    cell = lambda name: F.get("cells", F.lit(place[name])) if name in place else F.lit(None).cast("string")
    rest = sorted(n for n in place if n not in OWN_COLUMNS)
    more = F.when(F.size("cells") > len(header), F.slice("cells", F.lit(len(header) + 1), F.size("cells")))

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [dict(zip(rest, kept, strict=True)) | ({"None": list(extra)} if extra is not None else {}) for kept, extra in zip(batch["kept"], batch["more"], strict=True)]
            batch["metadata"] = [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in values]
            yield batch[[c.split()[0] for c in RECORD.split(", ")]]

    kept = F.array(*(cell(n) for n in rest)) if rest else F.array().cast("array<string>")
    out = filled.select(_blank(cell("source_text")).alias("source"), _blank(cell("target_text")).alias("target"), F.lit(path).alias("origin"), (F.col("position") + 2).alias("row_number"), F.nullif(cell("domain"), F.lit("")).alias("domain"), F.lit(file_ord).alias("file_ord"), kept.alias("kept"), more.alias("more"))
    return out.mapInPandas(document, RECORD)


#: The fields of a record that are not its metadata.
OWN_FIELDS = {"source", "target", "source_text", "target_text", "domain"}


def _record(document: dict) -> tuple[str, str, str | None, str]:
    sides = [document.get(side, document.get(f"{side}_text")) for side in ("source", "target")]
    source, target, domain = (x if isinstance(x, str) else None for x in (*sides, document.get("domain")))
    rest = {k: document[k] for k in document.keys() - OWN_FIELDS}
    return source or "", target or "", domain, json.dumps(rest, ensure_ascii=False, sort_keys=True)


def read_jsonl(spark: SparkSession, root: str, path: str, file_ord: int = 0) -> DataFrame:
    """One object a line, with source and target or source_text and target_text; any other line fails the load."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, line in zip(batch["row_number"], batch["line"], strict=True):
                try:
                    document = json.loads(line)
                except json.JSONDecodeError as x:
                    raise DatasetFormatError(f"{path}, line {n} is not JSON: {x}") from x
                if not isinstance(document, dict):
                    raise DatasetFormatError(f"{path}, line {n} is no object")
                source, target, domain, rest = _record(document)
                out.append((source, target, path, n, domain, rest, file_ord))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return numbered_lines(spark, f"{root}/{path}").mapInPandas(records, RECORD)


def read_all(spark: SparkSession, root: str, inputs: list[str]) -> DataFrame:
    """All inputs, in the order given."""
    parts = []
    for k, path in enumerate(inputs):
        name = path.rpartition("/")[2]
        if name == "source.txt":
            parts.append(read_parallel_text(spark, root, path, path[: -len(name)] + "target.txt", k))
        elif name != "target.txt":
            reader = {"tsv": read_tsv, "csv": read_csv, "jsonl": read_jsonl}[name.rpartition(".")[2].lower()]
            parts.append(reader(spark, root, path, k))
    return reduce(DataFrame.unionByName, parts)


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(row_number, source): the lines of a file to translate; a blank one is an error, as is a file without lines."""
    rows = numbered_lines(spark, path)
    if rows.isEmpty():
        raise DatasetFormatError(f"{path} holds no lines")
    blank = F.raise_error(F.concat(F.lit(f"{path}: blank line "), F.col("row_number").cast("string")))
    return rows.select("row_number", F.when(F.trim("line") == "", blank).otherwise(F.col("line")).alias("source"))


def read_records(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """The platform's own JSON Lines; a malformed line fails the load; reverse swaps the two sides."""
    schema = "source string, target string, origin string, row_number long, domain string"
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    return rows.select(F.col("target").alias("source"), F.col("source").alias("target"), "origin", "row_number", "domain") if reverse else rows


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event lines; those that can't be decoded (a partial last line) or are no objects are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_document(spark: SparkSession, path: str, default: object = None) -> object:
    """A JSON document, or the default where there is none."""
    folder, _, name = path.rpartition("/")
    if name not in _list(spark, folder):
        return default
    return json.loads(read_whole(spark, path).first()["text"])


def experiments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row for each manifest below root, newest id first, with its folder."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/manifest.json")
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/manifest\\.json$", 1)).orderBy(F.desc("folder"))
