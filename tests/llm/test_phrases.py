"""Fingerprints against a plain parse with sets."""

import hashlib
import random

import numpy as np

from paralex.llm.phrases import likeness, phrase_fingerprints, parse, signature, written


def brute_phrases(data):
    seen, out, cur = set(), [], b""
    for k in range(len(data)):
        cur += data[k : k + 1]
        if cur not in seen:
            seen.add(cur)
            out.append(cur)
            cur = b""
    return out + ([cur] if cur else [])


def test_parse():
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(80)))
        ends: list = []
        parse(data, {}, ends)
        stops = ends if ends and ends[-1] == len(data) else [*ends, len(data)] if data else []
        assert [data[a:b] for a, b in zip([0, *stops], stops)] == brute_phrases(data)


def plain(text):
    ends: list = []
    data = text.encode()
    parse(data, {}, ends)
    return signature(data, ends)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = plain(t), plain(e), plain(n)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, c)))
    return sorted(map(repr, out))


def test_whole(spark):
    rng = random.Random(2)
    words = ["ab", "é", "\U0001f600", " ", "the ", "of ", "x"]
    rows = [(k * 3, "".join(rng.choice(words) for _ in range(rng.randrange(200)))) for k in range(150)]
    rows += [(6, rows[2][1]), (6, rows[2][1]), (9, "other"), (None, "null"), (1000, None), (1001, ""), (0, "same id as the first")]
    for some in (rows, rows[:1], rows[:2], []):
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
        assert sorted(repr(tuple(r)) for r in phrase_fingerprints(docs).collect()) == brute(some)


def test_likeness_follows_the_overlap():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinsh"), rng.integers(2, 9))) for _ in range(800)]
    a = " ".join(rng.choice(words, 900))
    half = a[: len(a) // 2] + " ".join(rng.choice(words, 450))
    other = " ".join(rng.choice(words, 900))
    x, y, z = plain(a), plain(half), plain(other)
    assert likeness(x, x) == 1.0
    assert likeness(x, y) > likeness(x, z) + 0.15
