"""N-gram overlaps counted on Arrow columns against counters of a row's n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paralex.operators import metrics


def brute(rows, orders):
    out = []
    for n in range(1, orders + 1):
        grams = [[Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in row] for row in rows]
        out += [sum(sum((c & r).values()) for c, r in grams), *(sum(sum(g[k].values()) for g in grams) for k in (0, 1))]
    return out


def test_overlaps_of_rows_cut_anywhere(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(0, 30)))
    rows = [(text(), text()) for _ in range(300)] + [("", ""), (None, "ab"), ("ab", None)]
    table = spark.createDataFrame(rows, "candidate string, reference string").repartition(3)
    known = [tuple(x or "" for x in r) for r in rows]
    assert list(metrics.chrf_statistics(table).first()) == brute(known, 6)
    words = spark.createDataFrame([tuple(" ".join(x) for x in r) for r in known], "candidate string, reference string")
    got = metrics.bleu_statistics(words).first()
    want = brute(known, 4)
    assert [got[f"match_{n}"] for n in range(1, 5)] == want[::3] and [got[f"total_{n}"] for n in range(1, 5)] == want[1::3]
    assert tuple(metrics.chrf_statistics(table.limit(0)).first()) == (0,) * 18


def test_a_part_holds_a_bounded_number_of_tokens():
    """Texts reach Python as strings, counted in parts however many rows a batch has."""
    batch = pa.record_batch([pa.array(["ab" * 50] * 100), pa.array(["ab" * 50] * 100)], ["candidate", "reference"])
    parts = list(metrics._pieces(batch, 1000))
    assert sum(p.num_rows for p in parts) == 100 and max(p.num_rows for p in parts) <= 6
    tokens, lengths = metrics._numbers(pa.array(["aé", None, "\U0001f600"]))
    assert tokens.tolist() == [97, 233, 0x1F600] and np.asarray(lengths).tolist() == [2, 0, 1]


def test_the_tokenizer_leaves_spaces_alone(spark):
    """As the published substitutions, which put spaces around spaces too; here those aren't matches."""
    rng = random.Random(6)
    rows = ["".join(rng.choice("a1 .,-!/&{[~'\t") for _ in range(rng.randrange(20))) for _ in range(2000)]

    def plain(x):
        x = f" {x} "
        for pattern, into in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
            x = re.sub(pattern, into, x)
        return x.split()

    tokens = metrics.tokenize_13a(F.col("x"))
    assert "\\` -" not in tokens._jc.toString() and "[-` -" not in tokens._jc.toString()
    got = {r["x"]: r["t"] for r in spark.createDataFrame([(x,) for x in rows], "x string").select("x", tokens.alias("t")).collect()}
    assert got == {x: plain(x) for x in rows}
