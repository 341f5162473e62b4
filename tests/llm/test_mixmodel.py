"""The base score against brute force; the model against held-out text and as a distribution."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from paralex.llm import mixmodel, wordbits
from paralex.llm.common import unsqueeze
from paralex.llm.mixmodel import mixing_scores


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def corpus():
    rng = random.Random(3)
    syllables = ["th", "er", "an", "ing", "on", "at", "é", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    common = [word() for _ in range(40)]
    rows = [(k, " ".join(rng.choice(common) if rng.random() < 0.7 else word() for _ in range(rng.randrange(120))).capitalize()) for k in range(400)]
    return [*rows, (None, "Null id"), (500, None), (501, ""), (502, "zq" * 3000), (1, rows[1][1]), (503, "9#! zzz qqq xxxxx 77777 @@@@")]


def test_scores(spark):
    rows = corpus()
    train = Counter(w for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i if i is not None else -1, len(w), sum(train[x] > 0 for x in w), n, round(base, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = mixing_scores(docs).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 1) for r in got)
    out = [r for r in got if r["held_out"]]
    # the base gives every unknown word the same, the model can't: its loss on them is small, its gain elsewhere is not
    assert sum(r["score"] for r in out) > 1.05 * sum(r["base_score"] for r in out)
    by = {r["doc_id"]: r for r in got}
    assert by[503]["bits_per_byte"] > 2 * sum(r["bits_per_byte"] for r in out) / len(out)
    again = {r["doc_id"]: r["score"] for r in mixing_scores(docs.repartition(5)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-3 * abs(r["score"]) + 1e-6 for r in got)


def test_repeated_lines_are_cheap(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioustnr") for _ in range(6))
    common = "\n".join(" ".join(word() for _ in range(12)) for _ in range(10))
    held = next(k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows = [(k, " ".join(word() for _ in range(120))) for k in range(60)] + [(k, common) for k in range(60, 80)] + [(held, common)]
    got = {r["doc_id"]: r for r in mixing_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held]["score"] > 0.5 * got[held]["base_score"]
    assert got[0]["score"] < 1.5 * got[held]["score"]


def test_little(spark):
    assert mixing_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = mixing_scores(spark.createDataFrame([(1, "one text")], "doc_id long, text string")).collect()
    assert got[0]["n_tokens"] == 3 and got[0]["score"] < 0


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (4, 9, 31):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in mixing_scores(docs.repartition(partitions), 5, 1).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in found[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 2e-4 for a, b in zip(found[0], other, strict=True))


def test_words_are_predicted_where_they_stand(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioustnr") for _ in range(5)) for _ in range(60)]
    after = {w: rng.sample(vocabulary, 2) for w in vocabulary}

    def text():
        words = [rng.choice(vocabulary)]
        while len(words) < 200:
            words.append(rng.choice(after[words[-1]]))
        return words

    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    words = text()
    shuffled = rng.sample(words, len(words))
    rows = [(k, " ".join(text())) for k in range(100)] + [(held[0], " ".join(words)), (held[1], " ".join(shuffled))]
    got = {r["doc_id"]: r for r in mixing_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[held[0]]["base_score"] - got[held[1]]["base_score"]) < 1e-6
    assert got[held[0]]["score"] > 0.5 * got[held[1]]["score"]


def made_up(n=3000):
    rng = np.random.default_rng(4)
    counts = np.concatenate([[1] * 50, rng.integers(2, 40, 300), [700, 700, 9000]])
    classes = wordbits.class_of(counts)
    sizes = np.bincount(classes, minlength=wordbits.CLASSES)
    masses = np.bincount(classes, weights=counts, minlength=wordbits.CLASSES).astype(np.int64)
    places = np.array([(classes[:k] == c).sum() if c else 0 for k, c in enumerate(classes)])
    pick = rng.choice(len(counts), n, p=counts / counts.sum())
    coder = wordbits.Coder(sizes, masses)
    first = np.array([0, n // 3, n])
    return coder, sizes, classes, places, wordbits.Tokens(coder, classes[pick], places[pick], first, np.array([True, False]))


def test_one_look_up_serves_several_bits():
    coder, _, _, _, tokens = made_up()
    for at, classes, size, contexts in tokens.blocks():
        code, _ = coder.code(classes, tokens.places[at])
        lines = {}
        for j, (m, _, slots) in enumerate(tokens.slots(code, size, contexts)):
            for k, slot in enumerate(slots):
                line, bits = lines.setdefault((k, j // wordbits.NEAR), (slot >> wordbits.NEAR, []))
                assert (slot >> wordbits.NEAR == line[:m]).all()
                assert all((slot != other[:m]).all() for other in bits)  # no two bits of a token share a pair
                bits.append(slot)


def test_odds_without_context_are_shares_of_words():
    coder, sizes, classes, places, _ = made_up()
    code, shared = coder.code(classes, places)
    for c, place, bits, same in zip(classes, places, code, shared, strict=True):
        for d in range(int(coder.width[c])):
            j, left = int(coder.steps[c]) + d, int(coder.width[c]) - d - 1
            mine = [x for x in range(sizes[c]) if x >> left == place >> left]
            beside = [x for x in range(sizes[c]) if x >> left == (place >> left) ^ 1]
            got = coder.odds[j][c + wordbits.CLASSES * min(2, max(0, int(same) - j + 1))]
            assert abs(got - math.log((len(mine) + 0.02) / (len(beside) + 0.02))) < 1e-3
            assert int(bits) >> (63 - j) & 1 == place >> left & 1


def test_counts_travel_whole():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 3, (2, 4096)).astype(np.uint32) * np.uint32(scale) for scale in (1, 300, 1_400_000_000)]
    parts[0][:, 7] = 0
    got = np.zeros((2, 4096), np.int64)
    for row in mixmodel._total(lambda x: x)(b for p in parts for b in mixmodel._ranges(p)):
        got.reshape(2 * mixmodel.RANGES, -1)[row.column("t")[0].as_py()] = unsqueeze(row.column("n")[0].as_py(), np.int64)
    assert (got == sum(p.astype(np.int64) for p in parts)).all()
