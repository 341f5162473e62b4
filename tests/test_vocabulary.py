"""Learned merges against one merge at a time over the whole corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paralex.operators import vocabulary


def brute(texts, merges):
    words = Counter(vocabulary.MARK + w[k : k + vocabulary.LONGEST] for t in texts if t for w in t.split() for k in range(0, len(w), vocabulary.LONGEST))
    parts = {w: list(w) for w in words}
    out = []
    for _ in range(merges):
        pairs: Counter = Counter()
        for w, n in words.items():
            for p in zip(parts[w], parts[w][1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append((*best, pairs[best]))
        for w, x in parts.items():
            k, new = 0, []
            while k < len(x):
                if tuple(x[k : k + 2]) == best:
                    new.append(x[k] + x[k + 1])
                    k += 2
                else:
                    new.append(x[k])
                    k += 1
            parts[w] = new
    return out, parts


@pytest.mark.parametrize("seed", range(3))
def test_merges(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "aé\U0001f600", "abcdefgh"][seed]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(12)] + [None, "", "a" * 250, "aaa aaaa"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want, parts = brute(texts, 30)
    got = vocabulary.learn_merges(vocabulary.distinct_words(docs), 30)
    assert got == want
    ranks = {(a, b): k for k, (a, b, _) in enumerate(got)}
    assert all(vocabulary.pieces(w, ranks) == x for w, x in parts.items())
    cut = {r["doc_id"]: r["pieces"] for r in vocabulary.encoded(docs, list(ranks)).collect()}
    assert all(cut[k] == [p for w in (t or "").split() for j in range(0, len(w), vocabulary.LONGEST) for p in parts[vocabulary.MARK + w[j : j + vocabulary.LONGEST]]] for k, t in enumerate(texts))


def test_ends_when_no_pair_is_left(spark):
    docs = spark.createDataFrame([("ab",), ("ab",)], "text string")
    out = vocabulary.vocabulary(docs, 50).orderBy("id").collect()
    assert [(r["piece"], r["kind"], r["n"]) for r in out][4:] == [("ab", "merge", 2), ("▁ab", "merge", 2), ("a", "character", 2), ("b", "character", 2), ("▁", "character", 2)]
    assert vocabulary.learn_merges(vocabulary.distinct_words(docs.where(F.lit(False))), 5) == []


def test_rounds_take_pairs_that_do_not_meet():
    assert vocabulary.disjoint([("a", "b", 9), ("c", "d", 8), ("b", "e", 7), ("f", "g", 6)]) == [("a", "b"), ("c", "d")]
    assert vocabulary.disjoint([("a", "b", 9), ("c", "d", 8), ("d", "e", 8)]) == [("a", "b")]
    assert vocabulary.disjoint([("a", "a", 9), ("c", "d", 8)]) == [("a", "a")]
