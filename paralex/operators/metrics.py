"""Corpus metrics as sums of row statistics: BLEU, chrF, TER, preservation means.

Each row's statistics come from its own tokens, so a corpus metric is one partial aggregation with no shuffle of text.
Tokens are found by built-in functions; n-gram overlaps are counted batch by batch on Arrow columns, TER's block shifts by an
Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paralex.functions import text as T

ORDERS = 4
CHAR_ORDERS = 6


def tokenize_13a(x: Column) -> Column:
    """The mteval-v13a tokens of a line."""
    x = F.replace(F.replace(F.replace(x, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    # fixed values: the four substitutions of the published tokenizer; its first class holds the space too, around which
    # more spaces change no token
    for pattern, into in ((r"[\{-\~\[-\`!-\&\(-\+\:-\@\/]", " $0 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        x = F.regexp_replace(x, pattern, into)
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


#: Tokens of both sides that are counted together, about; a single longer row is counted on its own.
TOKENS_AT_ONCE = 1 << 18


def _dense(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers made equal places in a row without gaps, and how many there are."""
    coded = pa.array(ids).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def overlaps(tokens: np.ndarray, lengths: np.ndarray, orders: int) -> list[int]:
    """match_n, candidate_n and reference_n for each n, over rows whose candidate's and reference's tokens (numbers below
    2**32) lie one after the other; lengths: of each side, candidate before reference.

    An n-gram is known by the place of its first n - 1 tokens, with their row, and by its last token: no hash, no
    collision."""
    side = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(tokens))  # tokens from here to the side's end
    token, kinds = _dense(tokens)
    gram, at, out = side >> 1, np.arange(len(tokens)), []
    for n in range(1, orders + 1):
        whole = left[at] >= n
        at, gram = at[whole], gram[whole]
        gram, size = _dense(gram * kinds + token[at + n - 1])
        own = side[at] & 1
        counts = [np.bincount(gram[own == k], minlength=size) for k in (0, 1)]
        out += [int(np.minimum(*counts).sum()), int((own == 0).sum()), int((own == 1).sum())]
    return out


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers and lengths of a column: words of lists, code points of strings; null has none."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        text = "".join(x for x in column.to_pylist() if x is not None)
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` tokens."""
    length = pc.utf8_length if pa.types.is_string(batch.schema.types[0]) or pa.types.is_large_string(batch.schema.types[0]) else pc.list_value_length
    sizes = sum(pc.fill_null(length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def overlap_sums(rows: DataFrame, candidate: Column, reference: Column, orders: int) -> DataFrame:
    """One row of sums over rows: match_n, candidate_n and reference_n of two columns of word lists, or of strings for
    their characters.  Each task counts a bounded number of tokens at a time, and gives a row of sums a part: the built-in
    functions would need a shuffle of all n-grams, or time with the square of a row's length."""
    names = [f"{x}_{n}" for n in range(1, orders + 1) for x in ("match", "candidate", "reference")]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * orders, np.int64)
        for batch in batches:
            for part in _pieces(batch, TOKENS_AT_ONCE) if batch.num_rows else ():
                both = pa.concat_arrays([c.cast(part.schema.types[0]) for c in part.columns])
                order = np.arange(2 * part.num_rows).reshape(2, -1).T.ravel()  # candidate and reference by turns
                total += overlaps(*_numbers(both.take(pa.array(order))), orders)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

    each = rows.select(candidate.alias("candidate"), reference.alias("reference")).mapInArrow(sums, ", ".join(f"{n} long" for n in names))
    return each.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))


def bleu_statistics(rows: DataFrame) -> DataFrame:
    """One row of sums over rows (candidate, reference)."""
    sums = overlap_sums(rows, tokenize_13a(F.col("candidate")), tokenize_13a(F.col("reference")), ORDERS)
    by_order = [x for n in range(1, ORDERS + 1) for x in (F.col(f"match_{n}"), F.col(f"candidate_{n}").alias(f"total_{n}"))]
    return sums.select(F.col("candidate_1").alias("candidate_length"), F.col("reference_1").alias("reference_length"), *by_order)


def with_bleu(stats: DataFrame) -> DataFrame:
    """Rows of sums with bleu: the k-th order without a match counts as half as much as the one before, from half a
    match on; 0 where no order has a match, or one has no n-grams."""
    c = F.col
    some = reduce(lambda a, b: a | b, (c(f"match_{n}") > 0 for n in range(1, ORDERS + 1)))
    whole = reduce(lambda a, b: a & b, (c(f"total_{n}") > 0 for n in range(1, ORDERS + 1)))
    missing, logs = F.lit(0), F.lit(0.0)
    for n in range(1, ORDERS + 1):
        missing = missing + (c(f"match_{n}") == 0).cast("int")
        share = F.when(c(f"match_{n}") == 0, F.pow(F.lit(0.5), missing)).otherwise(c(f"match_{n}")) / c(f"total_{n}")
        logs = logs + F.log(100 * share)
    brevity = F.least(F.lit(1.0), F.exp(1 - c("reference_length") / c("candidate_length")))
    return stats.withColumn("bleu", F.when(some & whole, brevity * F.exp(logs / ORDERS)).otherwise(0.0))


def bleu_score(stats: DataFrame) -> float:
    return with_bleu(stats).first()["bleu"]


def chrf_statistics(rows: DataFrame) -> DataFrame:
    """One row of sums over rows (candidate, reference): characters without white space, orders one to six."""
    chars = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return overlap_sums(rows, chars(F.col("candidate")), chars(F.col("reference")), CHAR_ORDERS)


def with_chrf(stats: DataFrame, beta: float = 2.0) -> DataFrame:
    """Rows of sums with chrf: of the mean precision and recall over the orders that both sides have; 0 without any."""
    orders = F.array(*(F.struct(*(F.col(f"{x}_{n}").alias(x) for x in ("match", "candidate", "reference"))) for n in range(1, CHAR_ORDERS + 1)))
    have = F.filter(orders, lambda o: (o["candidate"] > 0) & (o["reference"] > 0))
    mean = lambda side: F.aggregate(have, F.lit(0.0), lambda a, o: a + o["match"] / o[side]) / F.size(have)
    out = stats.withColumns({"__p": F.when(F.size(have) > 0, mean("candidate")), "__r": F.when(F.size(have) > 0, mean("reference"))})
    p, r = F.col("__p"), F.col("__r")
    score = F.when(p + r > 0, 100.0 * (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)
    return out.withColumn("chrf", score).drop("__p", "__r")


def chrf_score(stats: DataFrame) -> float:
    return with_chrf(stats).first()["chrf"]


def _masks(words: list[str]) -> dict[str, int]:
    """Each distinct word's places, as bits."""
    out: dict[str, int] = {}
    for j, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << j
    return out


def _distance(a: list[str], masks: dict[str, int], size: int) -> int:
    """Word edits from a to the `size` words behind masks, one or more: Myers' bit-vector recurrence (1999), where a row
    of the table of distances is two integers, its steps up and its steps down."""
    every, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = every, 0, size
    for word in a:
        same = masks.get(word, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(horizontal | up) & every, up & horizontal
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        up, down = fall | ~(vertical | rise) & every, rise & vertical
    return distance


def ter_edits(candidate: str, reference: str, longest: int = 10, farthest: int = 50) -> tuple[int, int]:
    """(edits, reference words): word edits after greedy block shifts, each of which costs one (Snover 2006)."""
    a, b = candidate.lower().split(), reference.lower().split()
    if not b:
        return len(a), 0
    masks = _masks(b)
    shifts, now = 0, _distance(a, masks, len(b))
    places: dict[str, list[int]] = {}
    for j, word in enumerate(b):
        places.setdefault(word, []).append(j)
    while now:
        best = None
        for i in range(len(a)):
            for j in places.get(a[i], []):
                if i == j or abs(i - j) > farthest:
                    continue
                size = 0
                while size < longest and i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
                    size += 1
                    rest = a[:i] + a[i + size :]
                    at = min(len(rest), j)
                    moved = rest[:at] + a[i : i + size] + rest[at:]
                    if moved != a:
                        gain = now - 1 - _distance(moved, masks, len(b))
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, moved
        if best is None:
            break
        shifts, a = shifts + 1, best[1]
        now = _distance(a, masks, len(b))
    return shifts + now, len(b)


@F.pandas_udf(StructType([StructField("edits", LongType()), StructField("words", LongType())]))
def ter_row(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ter_edits(c or "", r or "") for c, r in zip(candidate, reference, strict=True)], columns=["edits", "words"])


def ter(rows: DataFrame) -> DataFrame:
    """(edits, words, ter) of rows (candidate, reference)."""
    each = rows.select(ter_row("candidate", "reference").alias("t"))
    out = each.agg(F.coalesce(F.sum("t.edits"), F.lit(0)).alias("edits"), F.coalesce(F.sum("t.words"), F.lit(0)).alias("words"))
    return out.withColumn("ter", F.when(F.col("words") > 0, 100.0 * F.col("edits") / F.col("words")).otherwise(F.when(F.col("edits") > 0, 100.0).otherwise(0.0)))


def text_metrics(rows: DataFrame) -> DataFrame:
    """One row over rows (source, reference, candidate): means of exact match and preservation, and length statistics."""
    s, r, c = F.col("source"), F.col("reference"), F.col("candidate")
    words = {"source": T.word_count(s), "reference": T.word_count(r), "candidate": T.word_count(c)}
    each = rows.select(
        T.exact_match(c, r).cast("double").alias("exact_match"),
        *(T.preservation(s, c, p).alias(n) for n, p in (("number_accuracy", T.NUMBER), ("punctuation_accuracy", T.PUNCTUATION), ("placeholder_accuracy", T.PLACEHOLDER), ("markup_accuracy", T.MARKUP))),
        *(v.cast("long").alias(f"{k}_words") for k, v in words.items()),
    )
    means = ["exact_match", "number_accuracy", "punctuation_accuracy", "placeholder_accuracy", "markup_accuracy"]
    return each.agg(
        *(F.avg(m).alias(m) for m in means),
        *(F.avg(f"{k}_words").alias(f"{k}_mean_words") for k in words),
        (F.sum("candidate_words") / F.greatest(F.lit(1), F.sum("reference_words"))).alias("candidate_reference_ratio"),
        F.count("*").alias("sentence_count"),
    )


def unknown_rate(rows: DataFrame, unknown: str, generated: str) -> DataFrame:
    return rows.agg((F.sum(unknown) / F.greatest(F.lit(1), F.sum(generated))).alias("unknown_token_rate"))


def weighted_loss(rows: DataFrame, loss: str, tokens: str) -> DataFrame:
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    return rows.agg(mean.alias("loss"), T.perplexity(mean).alias("perplexity"))
