"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A profile lists the most frequent n-grams of one to three characters of a language, most frequent first.  A document's
own list is compared to each by out-of-place distance: the sum, over its n-grams, of how far the rank is from the
profile's, and the most possible where the profile lacks it.  The nearest language is predicted.

N-grams are of lower-case letters, with a mark at either end of a word.  A batch's n-grams are counted by one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.llm.common import U, mix, one, passes

PROFILE = 400
#: Bytes of text whose n-grams are sorted at once.
SORT_BYTES = 1 << 19
MARK = 1
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, its lower-case letter, or the mark."""
    if not _letters:
        table = np.full(0x110000, MARK, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, 40-bit hash) of every n-gram of every text."""
    joined = "\n" + "\n".join(texts) + "\n"
    x = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(U)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    doc = np.concatenate([[0], doc])
    letter = x != MARK
    pairs = letter[:-1] | letter[1:]
    triples = letter[1:-1]
    codes = np.concatenate([x[letter], ((x[:-1] << U(21)) | x[1:])[pairs], ((x[:-2] << U(42)) | (x[1:-1] << U(21)) | x[2:])[triples]])
    of = np.concatenate([doc[letter], doc[1:][pairs], doc[2:][triples]])  # the last character tells the document
    return of, mix(codes) >> U(24)


def counted(group: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, gram), in order, with their counts."""
    key = np.sort((group.astype(U) << U(40)) | gram)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(begins, len(key)))
    key = key[begins]
    return (key >> U(40)).astype(np.int64), key & U((1 << 40) - 1), count


def train(docs: DataFrame, sample_per_language: int = 4000, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's n-gram hashes, most frequent first, from docs (doc_id, text, lang).

    sample_per_language bounds the documents (by expectation) that a language's profile is fitted on; they are chosen
    by a hash of doc_id.  The profiles, `size` numbers a language, come to the driver.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, sample_per_language / r["count"]) for r in docs.groupBy("lang").count().collect()}
    if not share:
        return {}
    shares = F.create_map(*(F.lit(v) for pair in share.items() for v in pair))
    chance = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    docs = docs.where(chance < F.try_element_at(shares, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = one(batch.column("text"))
            names, lang = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for lo, hi in passes(texts, SORT_BYTES):
                of, gram = grams(texts.slice(lo, hi - lo).to_pylist())
                of, gram, n = counted(lang[lo:hi][of], gram)
                yield pa.RecordBatch.from_arrays([pa.array(names[of].tolist(), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = docs.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, U) for lang, g in out.items()}


def distances(texts: list[str], profiles: list[np.ndarray], size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """(mean out-of-place distance of each text to each profile as a share of the most possible, n-grams compared)."""
    of, gram, n = counted(*grams(texts))
    order = np.lexsort((-n, of))
    of, gram = of[order], gram[order]
    begin = np.searchsorted(of, np.arange(len(texts)))
    rank = np.arange(len(of)) - begin[of]
    top = rank < size
    of, gram, rank = of[top], gram[top], rank[top]
    used = np.bincount(of, minlength=len(texts))
    every = np.unique(np.concatenate(profiles))
    ranks = np.full((len(every) + 1, len(profiles)), -1)
    for k, p in enumerate(profiles):
        ranks[np.searchsorted(every, p), k] = np.arange(len(p))
    spot = np.searchsorted(every, gram)
    spot[every[np.minimum(spot, len(every) - 1)] != gram] = len(every)
    out = np.zeros((len(texts), len(profiles)))
    for k in range(len(profiles)):
        theirs = ranks[spot, k]
        away = np.where(theirs < 0, size, np.abs(theirs - rank))
        out[:, k] = np.bincount(of, weights=away, minlength=len(texts)) / np.maximum(1, used) / size
    return out, used


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """docs (text, others) with lang_pred and score.

    score is 1 less the distance to the nearest profile as a share of the most possible; of equal distances the
    language first in order is taken.  A text that is null or has no letter is ``und`` with score 0, and so is every
    text where no language was learned.  Columns of those names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names, lists = sorted(profiles), [profiles[x] for x in sorted(profiles)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = one(batch.column("text"))
            lang, score = [], []
            for lo, hi in passes(texts, SORT_BYTES):
                if not names:
                    lang += ["und"] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                away, used = distances(["" if t is None else t for t in texts.slice(lo, hi - lo).to_pylist()], lists, size)
                best = away.argmin(axis=1)
                lang += [names[b] if u else "und" for b, u in zip(best, used, strict=True)]
                score += np.where(used > 0, 1 - away[np.arange(hi - lo), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(scan, schema)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the part; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def identify(docs: DataFrame, sample_per_language: int = 4000) -> DataFrame:
    """docs (doc_id, text, lang, others) with held_out, lang_pred and score; profiles learn from the rows that are not
    held out and have a language.  Repeated rows count as often as they occur; an empty table gives no rows."""
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(docs, train(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"), sample_per_language))
