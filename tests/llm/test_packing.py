"""Tokenization and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paralex.llm.packing import best_fit_pack, sum_of_squares

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(11)
    bits = ["a", "the", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "'s", "'", "12", "...", "日本", "\U0001f600", "<|endoftext|>", "\u0085", "ÿ", "x́", "\x1c"]
    return [None, "", " ", "<|endoftext|>"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)] + [" ".join(rng.choice(bits) for _ in range(6000))]


def test_round_trip(spark):
    t = texts()
    rows = [*enumerate(t), (None, "again"), (None, "again")]
    tok = Tokenizer.from_file(PATH)
    want = []
    for k, x in rows:
        ids = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        want += [(k or -1, j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, capacity=256).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 256


def test_sum_of_squares_is_near_the_least():
    rng = np.random.default_rng(2)
    for lengths in (np.minimum(2048, rng.exponential(700, 6000).astype(int) + 1), rng.integers(1, 2049, 6000), np.full(500, 700)):
        lengths = np.sort(lengths)[::-1]
        sequence, offset = sum_of_squares(lengths, 2048)
        assert (np.bincount(sequence, weights=lengths) <= 2048).all()
        if lengths[0] != lengths[-1]:
            assert sequence.max() + 1 <= 1.02 * lengths.sum() / 2048 + np.sum(lengths > 1024) * 0.02 + 3


def test_empty(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
