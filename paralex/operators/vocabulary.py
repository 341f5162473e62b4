"""Learning a sub-word vocabulary: byte-pair merges (Sennrich et al. 2016) as an iterative aggregate over distinct words.

The corpus is reduced to distinct words with counts once; that table never changes.  A word's pieces follow from the
merges so far, so no round rewrites words: a round filters those that contain a merged piece's text (a scan in the JVM),
splits them by the merges before and after, and adds the difference of their pairs to the table of pair counts.  Python
and shuffles see words that the round touches, and pairs that it changes, only.

A round takes several merges where that gives what one at a time would: pairs from the top of the order by count, until
one shares a piece with a pair already taken.  A merge makes new pairs out of those that share a piece with it, and a new
pair is no more frequent than the pair it comes from, so it can't overtake a pair that is strictly more frequent than the
first one left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.operators.tables import written

#: Stands before a word's first character, so that pieces tell where words begin.
MARK = "▁"
#: A longer word is counted in parts of so many characters.
LONGEST = 100
#: Pairs that one round looks at; a bound on what comes to the driver.
CANDIDATES = 256
#: The special pieces, in the order of their ids.
SPECIAL = ["<pad>", "<unk>", "<s>", "</s>"]

Pair = tuple[str, str]


def distinct_words(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n): distinct words, marked, with their number; words are parted by white space, null texts have none."""
    words = F.explode(F.regexp_extract_all(column, F.lit(rf"(?U)[^\s\x1c-\x1f]{{1,{LONGEST}}}"), F.lit(0)))
    return texts.select(words.alias("w")).groupBy("w").agg(F.count("*").alias("n")).select(F.concat(F.lit(MARK), "w").alias("word"), "n")


def joined(parts: list[str], pair: Pair) -> list[str]:
    """The pieces with a pair joined wherever it stands, from left to right."""
    out: list[str] = []
    ready = False  # whether the last piece may still be joined
    for part in parts:
        if ready and (out[-1], part) == pair:
            out[-1] += part
            ready = False
        else:
            out.append(part)
            ready = True
    return out


def pieces(word: str, ranks: dict[Pair, int]) -> list[str]:
    """A word's pieces: the merge learned first is done first, wherever its pair stands, from left to right."""
    parts, rank, none = list(word), ranks.get, len(ranks)
    order = [rank(p, none) for p in zip(parts, parts[1:])] if ranks else []
    while order and (first := min(order)) < none:
        while first in order:  # a new piece is longer than either part, so its pairs are others
            k = order.index(first)
            parts[k] += parts.pop(k + 1)
            del order[k]
            if k:
                order[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(order):
                order[k] = rank((parts[k], parts[k + 1]), none)
    return parts


def disjoint(order: list[tuple[str, str, int]]) -> list[Pair]:
    """The merges that a round can take from pairs (a, b, count) in their order, the first one at least."""
    taken: list[tuple[str, str, int]] = []
    used: set[str] = set()
    bound = order[-1][2] if len(order) >= CANDIDATES else 0  # more pairs may follow
    for a, b, n in order:
        if used & {a, b}:
            bound = n
            break
        taken.append((a, b, n))
        used |= {a, b}
        if a == b:  # overlaps itself: its own new pairs are bounded by itself alone
            bound = n
            break
    return [(a, b) for k, (a, b, n) in enumerate(taken) if k == 0 or n > bound]


def _changes(words: DataFrame, before: list[Pair], now: list[Pair]) -> DataFrame:
    """(a, b, n): by how much pair counts change in the words that the merges of a round touch, a part a row."""
    old, new = {p: k for k, p in enumerate(before)}, set(now)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            change: Counter[Pair] = Counter()
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                was = parts = pieces(word, old)
                if now and new.isdisjoint(zip(was, was[1:])):
                    continue
                for pair in now:  # later than all before, so they are done on what those leave
                    parts = joined(parts, pair)
                if len(parts) < len(was) or not now:
                    for p in zip(parts, parts[1:]):
                        change[p] += n
                    for p in zip(was, was[1:]) if now else ():
                        change[p] -= n
            rows = [(a, b, n) for (a, b), n in change.items() if n]
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["a", "b", "n"])

    touched = words
    if now:
        some = F.lit(False)
        for a, b in now:
            some = some | F.contains("word", F.lit(a + b))
        touched = words.where(some)
    return touched.mapInArrow(scan, "a string, b string, n long")


def learn_merges(words: DataFrame, merges: int) -> list[tuple[str, str, int]]:
    """(a, b, count) of the merges in order, fewer where no pair is left: each joins the most frequent pair of
    neighbouring pieces, of equals the least by code point.  words: (word, n), distinct.

    A pair is counted wherever it stands, overlaps with itself included, and joined from left to right.
    """
    words = written(words, "words")
    total = lambda rows: written(rows.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
    counts = total(_changes(words, [], []))
    found: list[tuple[str, str, int]] = []
    while len(found) < merges:
        top = counts.orderBy(F.desc("n"), "a", "b").limit(CANDIDATES).collect()
        if not top:
            break
        order = [(r["a"], r["b"], r["n"]) for r in top]
        # Spark orders strings by their bytes, so by code point
        now = disjoint(order)[: merges - len(found)]
        before = [(a, b) for a, b, _ in found]
        found += [x for x in order if (x[0], x[1]) in now][: len(now)]
        if len(found) < merges:
            counts = total(counts.unionByName(_changes(words, before, now)))
    return found


def vocabulary(texts: DataFrame, merges: int, column: str = "text") -> DataFrame:
    """(id, piece, kind, n): the special pieces, the merged ones in their order with the count of their pair when it was
    joined, and all characters by falling frequency, of equals by code point."""
    spark = texts.sparkSession
    words = written(distinct_words(texts, column), "words")
    learned = learn_merges(words, merges)
    fixed = [(k, p, "special", 0) for k, p in enumerate(SPECIAL)]
    fixed += [(k, a + b, "merge", n) for k, (a, b, n) in enumerate(learned, len(SPECIAL))]
    letters = words.select(F.explode(F.split("word", "")).alias("piece"), "n").where("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").collect()
    # one row a distinct character, of which Unicode has a bounded number
    fixed += [(k, r["piece"], "character", r["n"]) for k, r in enumerate(letters, len(fixed))]
    return spark.createDataFrame(fixed, "id long, piece string, kind string, n long")


def encoded(texts: DataFrame, learned: list[Pair], column: str = "text") -> DataFrame:
    """texts with pieces: the text's words cut by the merges; a null text has none.  Each distinct word is cut once."""
    ranks = {p: k for k, p in enumerate(learned)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [pieces(w, ranks) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(cut, pa.list_(pa.string()))], ["word", "cut"])

    rows = texts.withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows, "texts")  # so that row numbers don't change
    words = F.regexp_extract_all(column, F.lit(rf"(?U)[^\s\x1c-\x1f]{{1,{LONGEST}}}"), F.lit(0))
    places = rows.select("__row", F.posexplode(words).alias("at", "w")).withColumn("word", F.concat(F.lit(MARK), "w"))
    cuts = places.select("word").distinct().mapInArrow(scan, "word string, cut array<string>")
    whole = places.join(cuts, "word").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "cut"))).alias("c"))
    flat = F.flatten(F.transform("c", lambda c: c["cut"]))
    return rows.join(whole, "__row", "left").select(*texts.columns, F.coalesce(flat, F.array().cast("array<string>")).alias("pieces"))
