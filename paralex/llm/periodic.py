"""Periodic runs of words: stretches that repeat their first words three times or more.

A suffix automaton of a text's words has a state for each set of end positions.  States are taken from the longest on,
and each passes its ordered positions to its suffix link, the smaller set into the larger.  A position that enters a set
gets new neighbours; where one is p words away and the state is p words long or longer, the words between are a square
of period p, and as the two positions were first met here, the square can't be extended to the left.  Squares of one
start and period are one run, which is then extended to the right.

Most text never comes that far.  In a run of q-word periods every `least - least / exponent` consecutive words, but for
its last period, stand again q words later, so a run lies within the stretch that repeated windows of that many words
cover.  NumPy finds those stretches over whole batches (Rabin-Karp hashes), and an automaton is built for each of them
alone: its runs are the text's, since windows that cover a longer run would have made the stretch longer.

Plan: one Arrow function over the input partitions, no shuffle.  Memory grows with the longest stretch (about half a
kilobyte a word), not with the partition.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paralex.llm.common import Texts, U, give_back, mix, one, passes, run_hashes

RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Automaton:
    """The suffix automaton of a list of numbers: for each state its length, its suffix link (-1: the root's), and the
    end position that it was made for (-1: a clone)."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.end = [0], [-1], [-1]
        steps: list[dict[int, int]] = [{}]
        last = 0
        for at, word in enumerate(words):
            now = self._state(at + 1, 0, at)
            steps.append({})
            p = last
            while p >= 0 and word not in steps[p]:
                steps[p][word] = now
                p = self.link[p]
            if p >= 0:
                q = steps[p][word]
                if self.length[q] > self.length[p] + 1:
                    clone = self._state(self.length[p] + 1, self.link[q], -1)
                    steps.append(dict(steps[q]))
                    while p >= 0 and steps[p].get(word) == q:
                        steps[p][word] = clone
                        p = self.link[p]
                    self.link[q] = clone
                    q = clone
                self.link[now] = q
            last = now

    def _state(self, length: int, link: int, end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        return len(self.length) - 1


def squares(words: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """(start, period) -> greatest end (inclusive) of the left-maximal repetitions that neighbours show, of `least`
    words and `exponent` periods or more."""
    found: dict[tuple[int, int], int] = {}
    auto = Automaton(words)
    # positions are held as distances from the end: in a run, states get ever earlier ones, which so join at the back
    sets: list[list[int] | None] = [[-e] if e >= 0 else [] for e in auto.end]
    for state in np.argsort(-np.array(auto.length), kind="stable").tolist():
        mine, up = sets[state], auto.link[state]
        sets[state] = None
        if up <= 0:  # in the root everything meets, at length 0
            continue
        length, theirs = auto.length[up], sets[up]
        small, large = (mine, theirs) if len(mine) < len(theirs) else (theirs, mine)
        places = [bisect_left(large, x) for x in small]
        for x, at in zip(small, places, strict=True):  # only neighbours from the other set were never met before
            for y in large[max(0, at - 1) : at + 1]:
                period, end = abs(x - y), -min(x, y)
                if length >= (exponent - 1) * period and length + period >= least:
                    key = end - period - length + 1, period
                    if found.get(key, -1) < end:
                        found[key] = end
        for k, (x, at) in enumerate(zip(small, places, strict=True)):
            large.insert(at + k, x)
        sets[up] = large
    return found


def runs(words: list[int], least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of numbers, by start and period; period: the smallest one."""
    whole: dict[tuple[int, int], int] = {}
    for (start, period), end in squares(words, least, exponent).items():
        while end + 1 < len(words) and words[end + 1] == words[end + 1 - period]:
            end += 1
        # a multiple of the smallest period has the same run; only that period counts
        whole[start, end] = min(period, whole.get((start, end), period))
    found = ((s, e - s + 1, p) for (s, e), p in whole.items())
    return sorted((s, n, p) for s, n, p in found if n >= max(least, exponent * p))


def stretches(pieces: np.ndarray, doc: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """[begin, end) of the stretches of words (hashes, in documents) that can hold runs: covered by windows that are
    repeated within the stretch."""
    width = max(1, least - least // exponent)
    at = np.arange(max(0, len(pieces) - width + 1))
    at = at[doc[at] == doc[at + width - 1]]
    window = run_hashes(pieces, at, at + width)
    where = doc[at].astype(U)
    while True:
        # windows of one hash in one document or stretch
        order = np.argsort(window + mix(where), kind="stable")
        key = (window + mix(where))[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        before = len(at)
        at, window, where = at[again], window[again], where[again]
        if not len(at):
            return []
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] > at[:-1] + width) | (where[1:] != where[:-1])
        begins = np.flatnonzero(fresh)
        if len(at) == before:
            ends = at[np.append(begins[1:], len(at)) - 1] + width
            return [(b, e) for b, e in zip(at[begins].tolist(), ends.tolist(), strict=True) if e - b >= least]
        # the next round asks for a repeat in the same stretch; documents' numbers are no longer needed
        where = np.cumsum(fresh).astype(U)


def _found(t: Texts, least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Each document's runs."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(t.at) - 1)]
    pieces = t.hashes()
    for begin, end in stretches(pieces, t.doc, least, exponent):
        numbers = np.unique(pieces[begin:end], return_inverse=True)[1].tolist()
        base = begin - int(t.first[t.doc[begin]])
        out[t.doc[begin]] += [(s + base, n, p) for s, n, p in runs(numbers, least, exponent)]
    return out


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """docs (doc_id, text, others) with n_words, runs (start, length, period; by start, then period) and kept_text.

    Words are what white space (ASCII) parts, numbered from 0.  A run is a maximal stretch with that smallest period, of
    `least` words and `exponent` (3 or more) periods or more; no two runs are equal, but runs may overlap.  kept_text:
    the words that no run holds after its first period, joined by a space.  A null or empty text has no words, no runs
    and an empty kept_text.  Rows are judged on their own, so repeated rows and null doc_ids need no rule.  Columns named
    like the new ones are replaced.
    """
    if exponent < 3:
        raise ValueError("an exponent below 3 can hide a run behind nearer repeats")
    docs = docs.drop("n_words", "runs", "kept_text")
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = one(batch.column("text"))
            for lo, hi in passes(texts):
                t = Texts(texts.slice(lo, hi - lo)).words()
                found = _found(t, least, exponent)
                cover = np.zeros(len(t.starts) + 1, np.int64)
                for k, each in enumerate(found):
                    for start, length, period in each:
                        cover[t.first[k] + start + period] += 1
                        cover[t.first[k] + start + length] -= 1
                kept = t.joined(np.cumsum(cover)[:-1] == 0).cast(pa.string())
                listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in each] for each in found], RUN)
                columns = [batch.column(n).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(t.first)), listed, kept], [*names, "n_words", "runs", "kept_text"])
            give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{schema}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")
