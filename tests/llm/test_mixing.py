"""Mixing against the fix point that the contract names."""

import random
import re

from paralex.llm.mixing import mix_sources, targets


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        out = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 2 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets():
    rng = random.Random(5)
    for _ in range(200):
        sizes = {s: rng.randrange(0, 10 ** rng.randrange(1, 6)) for s in ["b", "a", "é", "\U0001f600", "Z", None][: rng.randrange(1, 7)]}
        want, got = brute_targets(sizes), targets(sizes)
        assert all(abs(want[s] - got[s]) <= 1e-9 * max(1, want[s]) for s in sizes)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * min(3000, int(rng.expovariate(1 / 60)))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(2000)]
    rows += [(None, None, "a"), (5, "x y", "b"), (5, "x y", "b"), (9000, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("text", "text")
    got = mix_sources(docs.selectExpr("*", "1 as size", "2 as target")).collect()
    again = mix_sources(docs.repartition(7)).select("doc_id", "size", "taken").collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"] or -1), r["size"], r["taken"]) for r in got) == sorted(((r["doc_id"] or -1), r["size"], r["taken"]) for r in again)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max([r["size"] for r in mine])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
