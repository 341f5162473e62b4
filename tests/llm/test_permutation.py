"""Recall of the permutation index against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paralex.llm import permutation
from paralex.llm.permutation import _index, nearest_pivots, permutation_search, spread


def brute(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32)).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1400] = x[0]
    if scale:
        x *= rng.uniform(0.9, 1.1, (len(x), 1))
    ids = np.arange(len(x))
    docs = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = permutation_search(docs.repartition(4), F.col("vec_id") % 20 == 0, k=20).collect()
    want, found = brute(ids, x, 20), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float((x[r["query_id"]] * x[r["vec_id"]]).sum())) < 1e-12
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in want]) >= 0.95
    if not scale:
        assert found[0] == want[0] == list(range(1000, 1020))


@pytest.mark.parametrize("kind", ["cluster", "tight cluster", "lengths"])
def test_skewed_vectors_are_found(spark, kind):
    """A third of the rows in a cluster, or lengths of all sizes: found through a third of the rows or fewer."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.lognormal(0, 0.5, (len(x), 1))
    else:
        noise = rng.normal(size=(3000, 64)) / 8
        x[:3000] = x[0] + noise * (0.3 if kind == "cluster" else 0.02)
    ids = rng.permutation(len(x))
    docs = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = permutation_search(docs, F.col("vec_id") % 100 == 0, k=20).collect()
    found, scored = {}, {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        scored[r["query_id"]] = r["scored"]
    want = {q: near for q, near in brute(ids, x, 20).items() if q % 100 == 0}
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    recall = [len(set(found[q]) & set(want[q])) / 20 for q in want]
    share = [n / len(x) for n in scored.values()]
    print(kind, "recall", np.mean(recall), min(recall), "share", np.mean(share), max(share))
    assert np.mean(recall) >= 0.95 and np.mean(share) < 1 / 3


def test_few_rows_and_many_asked(spark):
    """Fewer candidates than asked for: all are returned, whatever the lists hold."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 150):
        x = rng.normal(size=(n, 5))
        docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = permutation_search(docs, F.col("vec_id") == 0, k=200, least=4).collect()
        order = np.lexsort((np.arange(n), -(x * x[0]).sum(axis=1)))
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [j for j in order if j]


def test_index_lists_hold_each_row_at_its_rank():
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(300, 16)), rng.permutation(300)
    pivots = spread(x, 20)
    table = pa.table({"vec_id": pa.array(ids), "embedding": pa.array(list(map(list, x)))})
    row = _index(pivots, 15)((pa.scalar(0, pa.int32()),), table).to_pylist()[0]
    assert np.frombuffer(row["ids"], np.int64).tolist() == list(range(300))
    want = {(int(p), int(ids[r]), n) for r in range(300) for n, p in enumerate(nearest_pivots(x[r : r + 1], pivots, 15)[0])}
    got = {(p, int(m), int(n)) for p, (members, ranks) in enumerate(zip(row["members"], row["ranks"])) for m, n in zip(np.frombuffer(members, np.int32), np.frombuffer(ranks, np.uint8))}
    assert got == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [1.0]), (None, [1.0, 1.0]), (140, [0.0, -1.0]), (1, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = permutation_search(docs, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 140, 0.0), (140, 1, 0, 0.0), (140, 2, 1, -0.5), (140, 3, 2, -0.5)]
    assert permutation_search(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_query_walks_a_small_part_of_the_lists(spark, monkeypatch):
    """Entries of lists that a query walks, for each row: 36 when rows were posted to three quarters of the pivots."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    kept, asked = [], []
    stash, search = permutation.stash, permutation._search
    monkeypatch.setattr(permutation, "stash", lambda df, name: kept.append(out := stash(df, name)) or out)
    monkeypatch.setattr(permutation, "_search", lambda k, posted, *more: asked.append(posted) or search(k, posted, *more))
    assert permutation.permutation_search(docs, F.col("vec_id") % 20 == 0, k=20).count() == 150 * 20
    lists = [len(m) // 4 for r in kept[0].collect() for m in r["members"]]
    assert sum(lists) == asked[0] * len(x)  # every row is indexed
    assert sum(lists) / len(lists) * (len(lists) / 8) <= 10 * len(x)
