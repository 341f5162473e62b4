"""Repeated windows against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paralex.llm.windows import line_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, unit, width):
    units = [WORD.findall(t or "") if unit == "words" else (t or "").split("\n") for _, t in rows]
    first: dict = {}
    place = lambda d, i: (d is not None, d if d is not None else 0, i)

    def windows(k):
        for i in range(len(units[k]) - width + 1):
            w = tuple(units[k][i : i + width])
            if unit == "words" or WORD.search("".join(w)):
                yield i, w

    for k, (d, _) in enumerate(rows):
        for i, w in windows(k):
            first[w] = min(first.get(w, place(d, i)), place(d, i))
    out = []
    for k, (d, _) in enumerate(rows):
        gone = {p for i, w in windows(k) if first[w] < place(d, i) for p in range(i, i + width)}
        kept = [u for p, u in enumerate(units[k]) if p not in gone]
        spans, at = [], 0
        while at < len(units[k]):
            if at in gone:
                end = at
                while end in gone:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out.append((d, len(units[k]), len(gone), (" " if unit == "words" else "\n").join(kept), spans))
    return sorted(map(repr, out))


def corpus():
    rng = random.Random(12)
    words = ["a", "b", "c", "é", "日本", "D"]
    piece = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)]
    rows = []
    for k in range(150):
        parts = [rng.choice(piece) if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        rows.append((k * 7 % 151, rng.choice([" ", "\n", "\t\n"]).join(parts)))
    return [*rows, (None, piece[0] + "\n" + piece[1] + "\n" + piece[2]), (900, None), (901, ""), (902, " \n\n\n\n "), (3, rows[0][1]), (3, rows[0][1]), (-5, piece[3]), (903, " ".join(piece * 3000))]


@pytest.mark.parametrize(("unit", "width"), [("words", 5), ("words", 1), ("lines", 3), ("lines", 2)])
def test_against_brute_force(spark, unit, width):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = (substring_dedup if unit == "words" else line_dedup)(docs, width).collect()
    assert sorted(repr((r["doc_id"], r["n_units"], r["n_removed"], r["kept_text"], [tuple(s) for s in r["spans"]])) for r in got) == brute(rows, unit, width)


def test_other_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "x y z", "s"), (2, "x y z", None)], "doc_id long, text string, source string").withColumn("n_units", F.lit("clash"))
    got = {r["doc_id"]: r for r in substring_dedup(docs, 2).collect()}
    assert got[2]["n_removed"] == 3 and got[2]["source"] is None and got[1]["source"] == "s" and got[2]["text"] == "x y z"
    assert substring_dedup(docs.limit(0)).count() == 0 and line_dedup(docs.limit(0)).count() == 0
