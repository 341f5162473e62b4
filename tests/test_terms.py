"""Terminology against a look at every term in every text."""

import random

from paralex.operators import terms


def brute(rows, dictionary):
    matched = total = 0
    for s, c in rows:
        for term, forms in dictionary:
            if s is not None and term is not None and term.casefold() in s.casefold():
                total += 1
                matched += any(f is not None and f.casefold() in (c or "").casefold() for f in forms or []) if c is not None else 0
    return matched, total, matched / total if total else 1.0


def test_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abßÉ ") for _ in range(rng.randrange(1, 5)))
    rows = [("".join(word() for _ in range(8)), "".join(word() for _ in range(6))) for _ in range(60)] + [(None, "a"), ("a", None), ("", "")]
    dictionary = [(word(), [word() for _ in range(rng.randrange(3))]) for _ in range(80)] + [("", ["a"]), ("STRASSE", ["ss", None]), (None, ["a"]), ("a", None), ("ab", ["b"]), ("ab", ["b"])]
    texts = spark.createDataFrame(rows, "source string, candidate string").repartition(3)
    table = spark.createDataFrame(dictionary, "term string, forms array<string>")
    for size in (terms.SHARD_CHARACTERS, 50):  # one shard, and many
        got = terms.terminology(texts, table, size).first()
        assert (got["matched"], got["total"], got["accuracy"]) == brute(rows, dictionary)
    assert tuple(terms.terminology(texts, table.limit(0)).first()) == (0, 0, 1.0)
    assert tuple(terms.terminology(texts.limit(0), table).first()) == (0, 0, 1.0)


def test_a_dictionary_of_many_terms(spark):
    """50,000 terms: no nested loop, and no bound on their number."""
    rng = random.Random(3)
    dictionary = [(f"term{k}x", [f"form{k}x"]) for k in range(50_000)]
    picks = [[rng.randrange(50_000) for _ in range(20)] for _ in range(300)]
    rows = [(" ".join(f"Term{k}X" for k in p), " ".join(f"form{k}x" for k in p[::2])) for p in picks]
    table = spark.createDataFrame(dictionary, "term string, forms array<string>")
    got = terms.terminology(spark.createDataFrame(rows, "source string, candidate string"), table, 1 << 18).first()
    assert got["total"] == sum(len(set(p)) for p in picks)
    assert got["matched"] == sum(len(set(p[::2])) for p in picks)


def test_a_dictionary_is_cut_into_no_shards(spark, monkeypatch):
    """However large the dictionary, texts are read once: no automaton, of which each text passed every one."""
    rng = random.Random(7)
    letters = "abcdeß\U0001f600 "
    dictionary = [("".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))), ["".join(rng.choice(letters) for _ in range(2))]) for _ in range(3000)]
    rows = [("".join(rng.choice(letters) for _ in range(rng.randrange(120))), rng.choice([None, "ab", "c d\U0001f600ss"])) for _ in range(150)] + [(None, "ab")]
    made = []
    shard = terms._shard
    monkeypatch.setattr(terms, "_shard", lambda *a: made.append(1) or shard(*a))
    table = spark.createDataFrame(dictionary, "term string, forms array<string>")
    got = terms.terminology(spark.createDataFrame(rows, "source string, candidate string").repartition(3), table, 2000).first()
    assert (got["matched"], got["total"], got["accuracy"]) == brute(rows, dictionary)
    assert not made
