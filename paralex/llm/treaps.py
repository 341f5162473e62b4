"""Ranked lexical search over inverted treaps.

The index holds blocks of documents.  In a block, each term has a posting list that is a treap: its search order is the
document's place, its heap order the posting's impact (equal impacts by a hash of the document, so that copies don't
make a chain).  The treap is held by its list and a sparse table of greatest impacts: a subtree is a range of the list,
its root the range's greatest entry, its children the ranges to either side.

A search goes down the treaps of an item's terms at once.  A state is an interval of documents with the subtree of every
term in it; the weighted impacts of the roots sum to a bound on any score inside.  A state whose bound can't enter the
item's best k is dropped whole.  Otherwise the root that adds most names a document, which is scored in all lists, and
every treap is split there into the states to the left and right.  Intervals of few documents are scored outright.
NumPy takes a step for all states of many items at once; a task carries its items' best k from block to block.

Plan: one pass over the text writes the index (no shuffle); N, L and the document frequencies are sums over its blocks;
one pass over the index searches; the best k of each task meet in one small shuffle by item.  Items come in rounds of a
bounded number of terms, which each task gets whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paralex.llm.common import Texts, U, give_back, mix, one, pack_rising, passes, small_batches, squeeze, stash, unpack_rising, unsqueeze

NULL_ID = -(1 << 63)
#: What parts terms: the ASCII characters that are no letters or digits.
PARTS = np.zeros(256, bool)
PARTS[:128] = [not chr(c).isalnum() for c in range(128)]
#: A block's text, about, and its documents at most.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
#: Intervals of so many documents are scored outright.
LEAF = 48
#: Terms of items that one round takes, about, and (state, term) pairs that a step takes at once.
ROUND_TERMS, STEP_PAIRS = 1 << 18, 1 << 20
#: Steps after which what is left is scored outright, however wide; treaps are that deep only by design of their input.
MOST_STEPS = 96

BLOCK_PARTS = ("ids", "lengths", "terms", "sizes", "places", "counts")
INDEX = "docs long, words long, " + ", ".join(f"{n} binary" for n in BLOCK_PARTS)
INDEX_ARROW = pa.schema([("docs", pa.int64()), ("words", pa.int64()), *((n, pa.binary()) for n in BLOCK_PARTS)])


class Terms(Texts):
    """Texts whose words() are terms: A-Z lower-cased, parted by PARTS."""

    def __init__(self, column: pa.Array):
        super().__init__(column, lower=True)
        inside, begin = ~PARTS[self.data], self._begin()
        fresh = np.ones(len(inside) + 1, bool)
        fresh[1:] = ~inside
        starts = np.flatnonzero(inside & (fresh[:-1] | begin[:-1]))
        over = begin.copy()
        over[:-1] |= ~inside
        over[-1] = True
        self._found(starts, np.flatnonzero(inside & over[1:]) + 1)


def _planes(x: np.ndarray) -> bytes:
    return squeeze(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _unplaned(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(x, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32).astype(np.int64)


def _block(ids: list[np.ndarray], lengths: list[np.ndarray], hashes: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
    """The index row of a block: postings by term, then by place."""
    ids, lengths, h, place = (np.concatenate(x) for x in (ids, lengths, hashes, places))
    order = np.argsort(h, kind="stable")  # places already rise
    h, place = h[order], place[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(h)))
    terms, sizes = np.unique(h[at], return_counts=True)
    row = [int((lengths > 0).sum()), int(lengths.sum()), squeeze(ids), _planes(lengths), pack_rising(terms), _planes(sizes), squeeze(place[at].astype(np.uint16)), _planes(counts)]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)


def index(docs: DataFrame) -> DataFrame:
    """INDEX of docs (doc_id, text), written to the shared folder: a row a block, with the number of its documents that
    hold a term, and of its terms.  A null text has none.  Terms are told apart by 64-bit hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, ...] = ([], [], [], [])
        size, held = 0, 0
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            texts = one(batch.column("text"))
            cuts = [(x, min(hi, x + BLOCK_DOCS)) for lo, hi in passes(texts) for x in range(lo, hi, BLOCK_DOCS)]
            for lo, hi in cuts:
                t = Terms(texts.slice(lo, hi - lo))
                if held and (size + len(t.data) > BLOCK_BYTES or held + hi - lo > BLOCK_DOCS):
                    yield _block(*parts)
                    parts, size, held = ([], [], [], []), 0, 0
                for x, part in zip((ids[lo:hi], np.diff(t.first), t.hashes(), t.doc + held), parts, strict=True):
                    part.append(x)
                size, held = size + len(t.data), held + hi - lo
        if held:
            yield _block(*parts)
        give_back()

    return stash(docs.select("doc_id", "text").mapInArrow(scan, INDEX), "treaps")


class Postings:
    """The treaps of some terms of a block, as ranges [at[t], at[t + 1]) of one list."""

    def __init__(self, row: dict, wanted: np.ndarray, documents: int, words: int):
        self.ids, lengths = unsqueeze(row["ids"], np.int64), _unplaned(row["lengths"])
        self.docs = len(self.ids)
        terms, sizes = unpack_rising(row["terms"]), _unplaned(row["sizes"])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        where = np.searchsorted(terms, wanted)
        where[where == len(terms)] = 0
        has = terms[where] == wanted if len(terms) else np.zeros(len(wanted), bool)
        size = np.where(has, sizes[where], 0) if len(terms) else np.zeros(len(wanted), np.int64)
        self.at = np.concatenate([[0], np.cumsum(size)])
        first = begin[where] if len(terms) else np.zeros(len(wanted), np.int64)
        pick = np.repeat(first - self.at[:-1], size) + np.arange(self.at[-1])
        self.place = unsqueeze(row["places"], np.uint16)[pick].astype(np.int64)
        count = _unplaned(row["counts"])[pick]
        self.key = np.repeat(np.arange(len(wanted)), size) * self.docs + self.place
        length = 75 + (25 * lengths * documents) // max(1, words)
        self.impact = (1_000_000_000 * count) // (1000 * count + 12 * length[self.place])
        # heap order: by impact, then by a hash of the document; rank: an entry's place in that order
        self.order = np.lexsort((mix(self.place.astype(U) + U(1)), self.impact))
        rank = np.empty(len(pick), np.int32)
        rank[self.order] = np.arange(len(pick), dtype=np.int32)
        self.greatest = [rank]
        longest = int(size.max(initial=0))
        while 2 << (len(self.greatest) - 1) <= longest:
            below, half = self.greatest[-1], 1 << (len(self.greatest) - 1)
            level = below.copy()
            level[:-half] = np.maximum(below[:-half], below[half:])
            self.greatest.append(level)
        self.greatest = np.array(self.greatest)

    def roots(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entries that are the roots of the subtrees [begin, end), none empty."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        return self.order[np.maximum(self.greatest[level, begin], self.greatest[level, end - (1 << level)])]


class Best:
    """Each item's best k (score, doc_id), and the score that a document needs to enter: the k-th, or 1."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least[item]
        if not good.any():
            return
        item, score, doc = (np.concatenate(x) for x in ((self.item, item[good]), (self.score, score[good]), (self.doc, doc[good])))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[place < self.k], item[place < self.k]
        self.item, self.score, self.doc = item, score[order], doc[order]
        last = place[place < self.k] == self.k - 1
        self.least[item[last]] = np.maximum(self.score[last], 1)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def traverse(block: Postings, item: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Offers every document of the block that may enter the best k of an item, each item being the pairs (item, term,
    weight) that follow one another."""
    begin, end = block.at[term], block.at[term + 1]
    some = (end > begin) & (weight > 0)
    item, term, weight, begin, end = (x[some] for x in (item, term, weight, begin, end))
    if not len(item):
        return
    fresh = np.append(True, item[1:] != item[:-1])
    state = np.cumsum(fresh) - 1  # of each pair
    whose, low, high = item[fresh], np.zeros(state[-1] + 1, np.int64), np.full(state[-1] + 1, block.docs)  # of each state
    for step in range(MOST_STEPS + 1):
        root = block.roots(begin, end)
        adds = weight * block.impact[root]
        heads = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
        bound = np.add.reduceat(adds, heads)
        alive = bound >= best.least[whose]
        leaf = alive & ((high - low <= LEAF) | (step == MOST_STEPS))
        # few documents: all of their postings
        of = leaf[state]
        if of.any():
            size = (end - begin)[of]
            entry = _ranges(begin[of], size)
            key = np.repeat(state[of], size) * block.docs + block.place[entry]
            order = np.argsort(key, kind="stable")
            key = key[order]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            score = np.add.reduceat((np.repeat(weight[of], size) * block.impact[entry])[order], cut)
            best.offer(whose[key[cut] // block.docs], score, block.ids[key[cut] % block.docs])
        split = alive & ~leaf
        of = split[state]
        if not of.any():
            return
        # the root that adds most names the document at which all treaps of its state are split
        most = np.zeros(len(bound), np.int64)
        top = np.maximum.reduceat(adds, heads)
        lead = adds == top[state]
        most[state[lead]] = block.place[root[lead]]
        number = np.cumsum(split) - 1
        whose, low, high, at = whose[split], low[split], high[split], most[split]
        state, term, weight, begin, end = number[state[of]], term[of], weight[of], begin[of], end[of]
        key = term * block.docs + at[state]
        middle = np.searchsorted(block.key, key)
        hit = middle < end
        hit[hit] = block.key[middle[hit]] == key[hit]
        heads = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
        score = np.add.reduceat(np.where(hit, weight * block.impact[np.minimum(middle, len(block.impact) - 1)], 0), heads)
        best.offer(whose, score, block.ids[at])
        # states to the left and right, those without postings left out
        sides = ((2 * state, begin, middle), (2 * state + 1, middle + hit, end))
        state, begin, end = (np.concatenate(x) for x in zip(*sides, strict=True))
        term, weight = np.tile(term, 2), np.tile(weight, 2)
        some = end > begin
        order = np.argsort(state[some], kind="stable")
        state, term, weight, begin, end = (x[some][order] for x in (state, term, weight, begin, end))
        if not len(state):
            return
        whose = np.repeat(whose, 2)
        low, high = np.stack([low, at + 1], 1).reshape(-1), np.stack([at, high], 1).reshape(-1)
        there, state = np.unique(state, return_inverse=True)
        whose, low, high = whose[there], low[there], high[there]


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): terms by hash; rows of one item_id are one item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Terms(one(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(t.doc)), pa.array(t.hashes().view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").mapInArrow(scan, f"item_id {kind}, term long")
    return stash(found.groupBy("item_id", "term").agg(F.count("*").alias("times")), "items")


def search(blocks: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of items (item_id, text) the k documents of an index that score highest,
    and above 0; equal scores by doc_id, a null one first.

    Rows that share a doc_id are documents of their own; rows that share an item_id are one item, a null one included.
    An item without a term that a document holds, and a null text, have no rows.  Other columns are not carried.
    """
    documents, words = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    terms = _item_terms(items)
    rounds = max(1, -(-terms.count() // ROUND_TERMS))
    found = [_round(blocks, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == n), k, documents, words) for n in range(rounds)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _round(blocks: DataFrame, terms: DataFrame, k: int, documents: int, words: int) -> DataFrame:
    """(item_id, doc_id, score): the best k of each task for the items of terms, ROUND_TERMS rows, about."""
    spark = blocks.sparkSession
    numbers = stash(terms.select("item_id").distinct().withColumn("item", F.row_number().over(W.orderBy("item_id")) - 1), "numbers")
    rows = terms.join(numbers, terms["item_id"].eqNullSafe(numbers["item_id"])).select("item", "term", "times").orderBy("item", "term").collect()
    item, hashed, times = (np.array([r[c] for r in rows], np.int64) for c in ("item", "term", "times"))
    wanted, term = np.unique(hashed.view(U), return_inverse=True)
    most = int(item.max(initial=-1)) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for held, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                _, mine, theirs = np.intersect1d(wanted, unpack_rising(held), assume_unique=True, return_indices=True)
                total[mine] += _unplaned(sizes)[theirs]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    with small_batches(spark, 16):
        counts = blocks.select("terms", "sizes").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(wanted), np.int64)
    for r in counts:  # a row a term of the round at most
        weight[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    weight = weight[term] * times

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(most, k)
        firsts = np.searchsorted(item, np.arange(most + 1))
        for batch in batches:
            for row in batch.to_pylist():
                block = Postings(row, wanted, documents, words)
                room = max(1, STEP_PAIRS * LEAF // max(LEAF, block.docs) // 4)
                lo = 0
                while lo < most:
                    hi = max(lo + 1, int(np.searchsorted(firsts, firsts[lo] + room, "right")) - 1)
                    pairs = slice(firsts[lo], firsts[hi])
                    traverse(block, item[pairs], term[pairs], weight[pairs], best)
                    lo = hi
        doc = pa.array(best.doc, mask=best.doc == NULL_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), doc, pa.array(best.score)], ["item", "doc_id", "score"])
        give_back()

    with small_batches(spark, 4):
        best = stash(blocks.select(*BLOCK_PARTS).mapInArrow(scan, "item long, doc_id long, score long"), "best")
    return best.join(numbers, "item").select("item_id", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search() of items (item_id, text) over an index() of docs (doc_id, text)."""
    return search(index(docs), items, k)
