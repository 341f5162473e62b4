"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from paralex.llm import jaccard
from paralex.llm.components import connected_components
from paralex.llm.jaccard import jaccard_groups


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    ids = {r: min((d for d in v if d is not None), default=None) for r, v in least.items()}
    return sorted(map(repr, ((d, len(sets[i]), ids[find(i)]) for i, (d, _) in enumerate(rows))))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(300)] + ["the", "The", "é"]
    texts = [[rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 6, 30, 120]))] for _ in range(60)]
    passage = [rng.choice(words) for _ in range(40)]
    hub = [rng.choice(words) for _ in range(90)]
    for _ in range(60):
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
    for _ in range(60):
        t = list(hub)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
        texts.append(passage + [rng.choice(words) for _ in range(rng.randrange(30))])
    rng.shuffle(texts)
    return [*enumerate(" ".join(t) for t in texts), (None, "a b c d e"), (900, "a B c d e"), (901, None), (902, " \n"), (3, "again"), (3, "again")]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_all_pairs(spark, k, percent):
    rows = corpus(k)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, percent)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows, k, percent)


def test_empty(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 50)] + [(100, 99), (99, 98), (7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(51)} | {98: 98, 99: 98, 100: 98, 200: 200, 201: 200}


def test_near_misses_of_a_large_group_never_become_pairs(spark, monkeypatch):
    """Copies of one passage that overlap by less than is asked for: the last round compared the sets of nearly each two."""
    rng = random.Random(11)
    passage = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        t = list(passage)
        for at in rng.sample(range(3, 147), 6):
            t[at] = rng.choice(["x", "y", "z"]) + str(at)
        rows.append((k, " ".join(t)))
    sizes = {}
    stash = jaccard.stash
    monkeypatch.setattr(jaccard, "stash", lambda df, name: sizes.setdefault(name, []).append(out := stash(df, name)) or out)
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows, 5, 80)
    met, linked = (sizes[name][-1].count() for name in ("met", "linked"))
    assert met <= linked + len(rows)


def test_parities_bound_the_overlap_from_above():
    rng = np.random.default_rng(3)
    for size in (1, 20, 200, 2000):
        every = rng.integers(0, 1 << 63, 2 * size).astype(np.uint64)
        for share in (0.0, 0.3, 0.9, 1.0):
            x = every[:size]
            y = np.concatenate([every[: int(share * size)], every[size : 2 * size - int(share * size)]])
            differ = sum(int(a ^ b).bit_count() for a, b in zip(jaccard.parities(x).view(np.uint64), jaccard.parities(y).view(np.uint64), strict=True))
            assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differ) // 2
