"""Delimited files, read in blocks of a few bytes, against the csv module over all lines."""

import csv
import json
import random

import pytest

from paralex.sources import readers

PIECES = ['"', '""', "a", "bc d", "é", "\t", ",", "\n", "\n", "\r\n", '\n"', ',"', '\t"', '",', '"\t', '"\n', ""]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_open_and_close_cells():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice([*PIECES, "x"]) for _ in range(rng.randrange(9))).replace("\n", "").replace("\r", "")
        for delimiter in ",\t":
            # the module tells by whether it takes another line into the record
            rows = list(csv.reader([line, "second", "third"], delimiter=delimiter))
            assert readers._quoted_at_end(line, False, delimiter) == (len(rows) == 1)
            rows = list(csv.reader(['"', line, "second", "third"], delimiter=delimiter))
            assert readers._quoted_at_end(line, True, delimiter) == (len(rows) == 1)


@pytest.mark.parametrize("seed", range(4))
def test_tsv(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PIECES if seed else [p for p in PIECES if '"' not in p]) for _ in range(700))
    text = ["", "source_text\ttarget_text\n", "source\n", '"open'][seed] + text
    (tmp_path / "x.tsv").write_bytes(text.encode())
    want = []
    for n, row in enumerate(csv.reader(text.splitlines(), delimiter="\t"), 1):
        if not (n == 1 and len(row) > 1 and row[0] in ("source", "source_text")):
            want.append((n, row[0] if row else "", row[1] if len(row) > 1 else "", (row[2] or None) if len(row) > 2 else None))
    got = readers.read_tsv(spark, str(tmp_path), "x.tsv")
    assert sorted((r["row_number"], r["source"], r["target"], r["domain"]) for r in got.collect()) == want
    assert readers.numbered_lines(spark, str(tmp_path / "x.tsv"), block=True).select("f", "b").distinct().count() > 5


@pytest.mark.parametrize("seed", range(3))
def test_csv(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    header = ["source_text,target_text,domain,x\n", 'target_text,y,"source_text",x,x\n', '"a\nb",source_text,target_text\n'][seed]
    text = header + "".join(rng.choice([*PIECES, ",", ",", "\n"]) for _ in range(600))
    (tmp_path / "x.csv").write_bytes(text.encode())
    want = []
    for n, row in enumerate(csv.DictReader(text.splitlines()), 2):
        rest = {str(k): v for k, v in row.items() if k not in readers.OWN_COLUMNS}
        want.append((n, row["source_text"] or "", row["target_text"] or "", row.get("domain") or None, json.dumps(rest, ensure_ascii=False, sort_keys=True)))
    got = readers.read_csv(spark, str(tmp_path), "x.csv")
    assert sorted((r["row_number"], r["source"], r["target"], r["domain"], r["metadata"]) for r in got.collect()) == want


def test_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.tsv").write_text("")
    assert readers.read_tsv(spark, str(tmp_path), "empty.tsv").count() == 0
    for text in ("", "\n", "a,b\n1,2\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(readers.DatasetFormatError):
            readers.read_csv(spark, str(tmp_path), "bad.csv")
