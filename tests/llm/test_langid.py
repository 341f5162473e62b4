"""Rank-order profiles: a brute-force version, held-out accuracy, odd texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paralex.llm.langid import distances, grams, held_out, identify


def brute_grams(text):
    out = Counter()
    for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
        w = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if w[i : i + n].strip():
                    out[w[i : i + n]] += 1
    return out


def test_gram_counts():
    texts = ["ab c", "", "A-b", "Éa 12", "x" * 50, "no\nend", "日本 語"]
    of, gram = grams(texts)
    for k, t in enumerate(texts):
        want = brute_grams(t)
        assert sorted(Counter(gram[of == k].tolist()).values()) == sorted(want.values()), t


def test_distance_prefers_its_own():
    of, gram = grams(["the thing that", "der die das der"])
    a, b = ([g for g, _ in Counter(gram[of == k].tolist()).most_common()] for k in (0, 1))
    import numpy as np

    away, used = distances(["that thing", "das die", "123"], [np.array(a, np.uint64), np.array(b, np.uint64)], 400)
    assert away[0, 0] < away[0, 1] and away[1, 1] < away[1, 0] and used[2] == 0


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    words = {"en": ["the", "of", "thing", "with", "ation", "er", "and"], "de": ["der", "ung", "sch", "ein", "heit", "über", "ß"], "fr": ["le", "eau", "tion", "é", "que", "ou", "les"]}
    rows = []
    for k in range(400):
        lang = rng.choice(list(words))
        text = " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60)))
        rows.append((k, text, lang if rng.random() < 0.9 else None, lang))
    rows += [(1000, None, "en", "und"), (1001, "", "en", "und"), (1002, "12 .. !", None, "und"), (None, "the thing", "en", "en"), (7, rows[7][1], "de", rows[7][3]), (1003, "the of " * 50000, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, true string").withColumn("score", F.lit("clash"))
    got = identify(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["true"] == "und")
    out = [r for r in got if r["held_out"] and r["true"] != "und"]
    assert len(out) > 60 and sum(r["lang_pred"] == r["true"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in identify(docs).collect()] == ["und"]
    assert identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("doc_id", "want"), [(0, False), (5, None)])
def test_fold(spark, doc_id, want):
    import zlib

    got = spark.createDataFrame([(doc_id,)], "d long").select(held_out(F.col("d")).alias("h")).first()["h"]
    assert got == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and (want is None or got == want)
