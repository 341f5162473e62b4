"""Periodic runs against a comparison of every pair of words at every distance."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from paralex.llm import periodic
from paralex.llm.queries import QUERIES


def brute(words, least, exponent):
    out = {}
    for p in range(1, len(words) // exponent + 1):
        begin = 0
        for i in range(p, len(words) + 1):
            if i == len(words) or words[i] != words[i - p]:
                if i - begin >= max(least, exponent * p) and i - begin > p:
                    out.setdefault((begin, i - begin), p)
                begin = i - p + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def planted(rng, letters, length):
    """Random words with some repeated blocks, whole and cut off."""
    words = []
    while len(words) < length:
        if rng.random() < 0.4:
            block = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
            words += (block * rng.randrange(2, 9))[: rng.randrange(2, 60)]
        else:
            words += [rng.choice(letters) for _ in range(rng.randrange(1, 20))]
    return words[:length]


@pytest.mark.parametrize("least,exponent", [(24, 3), (3, 3), (8, 4)])
def test_runs(least, exponent):
    rng = random.Random(least)
    for k in range(300):
        words = planted(rng, range(1 + k % 5), rng.randrange(120))
        assert periodic.runs(words, least, exponent) == brute(words, least, exponent)


def test_fibonacci_words_have_no_runs_of_four_periods():
    a, b = [0], [0, 1]
    for _ in range(11):
        a, b = b, b + a
    assert periodic.runs(b, 3, 3) == brute(b, 3, 3) != [] and periodic.runs(b, 4, 4) == []


def kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_texts(spark):
    rng = random.Random(3)
    texts = [" \n".join(f"w{x}é" for x in planted(rng, range(3 + k), 400)) for k in range(40)]
    texts += [None, "", " \t", "one", "la " * 5000, "a b c " * 8, "a b c " * 7 + "a b", "x " * 23]
    rows = [(k if k % 7 else None, t, "mine", 5) for k, t in enumerate(texts)] + [(1, texts[1], "mine", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, n_words int").repartition(3)
    got = periodic.periodic_runs(docs).collect()
    want = []
    for i, t, extra, _ in rows:
        words = (t or "").split()
        runs = brute(words, 24, 3)
        want.append((i, t, extra, len(words), runs, kept(words, runs)))
    plain = [(r["doc_id"], r["text"], r["extra"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in got]
    assert sorted(map(repr, plain)) == sorted(map(repr, want))
    assert sum(len(w[4]) for w in want) > 40
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, exponent=2)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["a", "b", "ç", "dd", "e"]) for _ in range(rng.randrange(300)))) for k in range(200)] + [(None, "x " * 30), (7, None), (26, ""), (12, "la la")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, looped = [], 0
    for i, t in rows:
        words = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            looped += 1
        runs = brute(words, 24, 3)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(kept(words, runs))))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert looped > 10 and sum(w[1] for w in want) > 5
