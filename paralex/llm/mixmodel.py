"""Language-model scoring by logistic context mixing.

A text is its words, then an end.  Words that training saw twice or more are told in bits of a code, predicted and mixed
where they stand in running text (wordbits).  Words seen once or never are escaped there and spelled out, closed by a space.
The bits of a spelling are predicted from hashed contexts, the last one to six bytes of the word: for each context the
corpus gives counts of zeros and ones.  The predictors' log-odds are summed with weights; a gate - how often the two longest
contexts were seen - picks the set of weights.  Weights are learned online, bit block after bit block, with each word's own
occurrence left out of the counts, in SHARDS parts of the range of hashes whose weights are averaged: whatever the
partitions, the same words are learned in one order.  An adaptive probability map corrects the mixed probability from how
such probabilities came out.

Lines that the corpus repeats are a vocabulary of their own: at the start of a line of LINE_TOKENS words or more, the
whole line may be told by its share among all lines, at a rate that adapts to the document; a training document's own
lines are left out for itself.

A spelling is computed once for each distinct word, as its contexts do not reach beyond the word.

Plan: groups of documents send each distinct word with its training count to the bucket of its hash; buckets sum the
counts and keep the words, written to the shared folder; the bit counts are gathered from them into tables of fixed size
(`CONTEXTS x 2**TABLE_BITS x 8` bytes, the only thing that is broadcast); a pass learns the weights, another scores the
words and answers the groups in the order they asked.  Groups write their documents as codes, a row a document; over these,
a pass counts the contexts of running text, another learns its weights, the last one scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm import wordbits
from paralex.llm.common import (
    Texts,
    U,
    dealt,
    group_count,
    mix,
    one,
    pack_rising,
    passes,
    run_hashes,
    shuffle_partitions,
    small_batches,
    squeeze,
    stash,
    unpack_rising,
    unsqueeze,
)

CONTEXTS = (1, 2, 3, 4, 6)
TABLE_BITS = 20
LEVELS = 8  # of how often a context was seen
GATES = LEVELS * LEVELS
APM_STEPS = 33
BLOCK_BYTES = 1 << 18
#: Parts of the vocabulary that learn weights on their own, and words of a block of theirs.
SHARDS = 24
SHARD_BLOCK = 32_768
END = b"\n"
#: Lines that the corpus' share of repeated lines counts as, against a document's own.
LINE_PRIOR = 2.0
LINE_TOKENS = 4

ASK = "b int, g int, hashes binary, words binary, counts binary, lines binary, line_counts binary"
ASK_NAMES = ["b", "g", "hashes", "words", "counts", "lines", "line_counts"]
WORDS = "b int, words binary, counts binary, tokens long, types long, once long, lines long, lines_once long, groups array<int>, spots array<binary>, line_counts array<binary>, sizes binary, masses binary"
TELL = "b int, g int, counts binary, places binary, costs binary, line_counts binary"
#: Running text, a row a document: classes and places (low and high half) of the tokens, log10 probabilities of those that
#: are spelled, and the lines' first and last tokens and how often they occur elsewhere.
CODED = "doc_id long, held_out boolean, h long, n_tokens long, n_known long, base_score double, size long, classes binary, low binary, high binary, spelled binary, begins binary, stops binary, others binary"
#: Training tokens, about, that a shard of running text learns weights from; SHARDS at least, whatever the partitions.
SHARD_TOKENS = 1 << 24
#: Parts of a context's table that are summed on their own.
RANGES = 16
#: Tokens of running text that are worked on at once.
TOKENS_AT_ONCE = 1 << 18


def held_out(doc_id: int | None, parts: int, part: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts == part


def _picked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The runs, each closed by a space."""
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.append(data, np.uint8(32))[np.repeat(starts - to[:-1], size) + np.arange(to[-1])]
    out[to[1:] - 1] = 32
    return out.tobytes()


def _runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(words == 32)
    return np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends


END_HASH = U(zlib.crc32(b"end"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets cut the range of hashes, so that all words in order of buckets, then of hashes, are in order of hashes."""
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values by first occurrence, the number of each entry's among them)."""
    d = pa.array(h, pa.uint64()).dictionary_encode()
    return d.dictionary.to_numpy(), d.indices.to_numpy().astype(np.int64)


class _Group:
    """Tokens of a group of documents: numbers of distinct words, by hash, in text order with an end for each document."""

    def __init__(self, table: pa.Table, spell: bool):
        self.ids, texts = table["doc_id"].to_pylist(), one(table["text"])
        tokens, docs, blobs, firsts, lines, begins, stops = [], [], [], [], [], [], []
        seen = known = 0
        self.size = np.zeros(len(self.ids), np.int64)
        for lo, hi in passes(texts):
            t = Texts(texts.slice(lo, hi - lo), lower=True).words()
            h = t.hashes()
            distinct, number = _numbered(h)
            firsts.append(distinct)
            tokens.append(number + known)
            known += len(distinct)
            docs.append(t.doc + lo)
            # lines: runs of words with no line feed between
            row = np.cumsum(t.data == 10)[t.starts] if len(h) else t.starts
            cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(t.doc) != 0)) + 1
            begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]])
            long = stop - begin >= LINE_TOKENS
            begin, stop = begin[long], stop[long]
            lines.append(run_hashes(h, begin, stop))
            shift = seen + t.doc[begin] + lo if len(begin) else begin  # an end stands after each document before
            begins.append(begin + shift)
            stops.append(stop + shift)
            seen += len(h)
            self.size[lo:hi] = np.bincount(t.doc, weights=t.ends - t.starts + 1, minlength=hi - lo)
            if spell:
                first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
                blobs.append(_picked(t.data, t.starts[first], t.ends[first]))
        none = [np.zeros(0, np.int64)]
        doc = np.concatenate(docs + none).astype(np.int64)
        here = np.bincount(doc, minlength=len(self.ids)) + 1
        self.doc = np.repeat(np.arange(len(self.ids)), here)
        self.first = np.concatenate([[0], np.cumsum(here)])
        every = np.concatenate([*firsts, [END_HASH]]).astype(U)
        self.words, at, inverse = np.unique(every, return_index=True, return_inverse=True)
        self.token = np.full(len(self.doc), inverse[-1])
        self.token[np.arange(len(doc)) + doc] = inverse[np.concatenate(tokens + none).astype(np.int64)]  # an end comes after its words
        self.begin, self.stop = np.concatenate(begins + none).astype(np.int64), np.concatenate(stops + none).astype(np.int64)
        self.lines, self.line = np.unique(np.concatenate([*lines, np.zeros(0, U)]), return_inverse=True)
        if spell:
            data = np.frombuffer(b"".join(blobs) + END + b" ", np.uint8)
            starts, stops = _runs(data)
            self.spelled, self.starts, self.stops = data, starts[at], stops[at]

    def buckets(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, its words, its lines), both by hash."""
        parts = []
        for hashes in (self.words, self.lines):
            b = bucket_of(hashes, buckets)
            by = np.argsort(b, kind="stable")
            parts.append((by, np.searchsorted(b[by], np.arange(buckets + 1))))
        (words, at), (lines, line_at) = parts
        for k in np.flatnonzero(np.diff(at) + np.diff(line_at)):
            yield int(k), words[at[k] : at[k + 1]], lines[line_at[k] : line_at[k + 1]]


def _ask(buckets: int, parts: int, part: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        group = _Group(table, True)
        learns = np.array([not held_out(i, parts, part) for i in group.ids], bool)
        counts = np.bincount(group.token[learns[group.doc]], minlength=len(group.words))
        line_counts = np.bincount(group.line[learns[group.doc[group.begin]]], minlength=len(group.lines))
        rows = [
            (
                k,
                key[0].as_py(),
                group.words[x].tobytes(),
                zlib.compress(_picked(group.spelled, group.starts[x], group.stops[x]), 1),
                squeeze(counts[x].astype(np.uint32)),
                group.lines[y].tobytes(),
                squeeze(line_counts[y].astype(np.uint32)),
            )
            for k, x, y in group.buckets(buckets)
        ]
        return pa.table([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(len(ASK_NAMES))], ASK_NAMES)

    return ask


def _gather(table: pa.Table) -> pa.Table:
    """One bucket's words and training counts, and where each group's stand among them."""
    asks = list(zip(*(table[n].to_pylist() for n in ASK_NAMES), strict=True))
    hashes = [np.frombuffer(a[2], U) for a in asks]
    distinct, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([unsqueeze(a[4], np.uint32) for a in asks])).astype(np.int64)
    data = np.frombuffer(b"".join(zlib.decompress(a[3]) for a in asks), np.uint8)
    starts, ends = _runs(data)
    words = _picked(data, starts[first], ends[first])
    spots = [pack_rising(np.searchsorted(distinct, h).astype(U)) for h in hashes]
    hashes = [np.frombuffer(a[5], U) for a in asks]
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    lines = np.bincount(inverse, weights=np.concatenate([unsqueeze(a[6], np.uint32) for a in asks])).astype(np.int64) if len(inverse) else np.zeros(0, np.int64)
    back = [squeeze(x.astype(np.uint32)) for x in np.split(lines[inverse], np.cumsum([len(h) for h in hashes])[:-1])]
    classes = wordbits.class_of(counts)
    sizes = np.bincount(classes[counts > 0], minlength=wordbits.CLASSES)
    masses = np.bincount(classes, weights=counts, minlength=wordbits.CLASSES).astype(np.int64)
    row = [asks[0][0], zlib.compress(words, 1), squeeze(counts), int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), int(lines.sum()), int((lines == 1).sum()), [a[1] for a in asks], spots, back, squeeze(sizes), squeeze(masses)]
    types = (pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.binary())
    return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], [x.split()[0] for x in WORDS.split(", ")])


# ---------------------------------------------------------------- the bit model


def _blocks(words: bytes, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of words: (bytes, the word of each byte within the block, the words' counts)."""
    data = np.frombuffer(words, np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    lo = 0
    while lo < len(ends):
        begin = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + BLOCK_BYTES, "right")))
        part = data[begin : ends[hi - 1]]
        yield part, np.repeat(np.arange(hi - lo), np.diff(np.concatenate([[begin], ends[lo:hi]]))), counts[lo:hi]
        lo = hi


def _kept(words: bytes, counts: np.ndarray, which) -> tuple[bytes, np.ndarray]:
    """The words whose count is one of those asked for, and their counts."""
    data, at = np.frombuffer(zlib.decompress(words), np.uint8), np.flatnonzero(which(counts))
    starts, ends = _runs(data)
    return _picked(data, starts[at], ends[at]), counts[at]


def _contexts(data: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """For each byte, hashes of the bytes before it in its word."""
    first = np.searchsorted(word, np.arange(word[-1] + 1))
    place = np.arange(len(data)) - first[word]
    history, out = np.zeros(len(data), U), []
    for back in range(1, max(CONTEXTS) + 1):
        before = np.zeros(len(data), U)
        before[back:] = data[:-back]
        before[place < back] = 0
        history |= before << U(8 * (back - 1))
        if back in CONTEXTS:
            out.append((mix(history * U(0x9E3779B97F4A7C15) + U(back)) >> U(32)).astype(np.uint32))
    return out


def _bits(data: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each bit of the bytes: (its values, the slot of each context).  A context is hashed for each half of the byte,
    whose 15 slots are near each other in memory."""
    byte = data.astype(np.int64)
    for half in range(2):
        node = ((1 << 4 * half) | (byte >> (8 - 4 * half))).astype(np.uint32) * np.uint32(0xC2B2AE35)
        starts = []
        for c in contexts:
            h = c ^ node
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h >>= np.uint32(32 - TABLE_BITS)
            starts.append(h.astype(np.int64))
        below = np.ones(len(data), np.int64)
        for place in range(4 * half, 4 * half + 4):
            bit = (byte >> (7 - place)) & 1
            yield bit, [s ^ below for s in starts]
            below = (below << 1) | bit


def _weight(counts: np.ndarray) -> np.ndarray:
    """How much a word's spelling teaches: known words are mostly told by their frequency, so it grows slowly.  In
    sixteenths, whose sums are exact in any order."""
    return np.round(np.where(counts > 0, 1 + np.log2(np.maximum(counts, 1)), 0.0) * 16) / 16


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zeros and ones seen in each slot by the words of a partition, in sixteenths."""
    seen = np.zeros((len(CONTEXTS), 2 << TABLE_BITS), np.uint32)
    for batch in batches:
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            for data, word, n in _blocks(*_kept(words, unsqueeze(counts, np.int64), lambda n: n > 0)):
                weight = np.round(_weight(n) * 16).astype(np.uint32)[word]
                for bit, slots in _bits(data, _contexts(data, word)):
                    for k, slot in enumerate(slots):
                        np.add.at(seen[k], slot << 1 | bit, weight)
    yield from _ranges(seen)


def _ranges(seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partition's tables (32-bit counts) in RANGES parts each, as planes of bytes."""
    for t, part in enumerate(seen.reshape(len(seen) * RANGES, -1)):
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([squeeze(part.view(np.uint8).reshape(-1, 4).T)], pa.binary())], ["t", "n"])


def _total(done):
    """The partitions' counts of each range together, and what is done of them."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, n in zip(batch.column("t").to_pylist(), batch.column("n").to_pylist(), strict=True):
                planes = unsqueeze(n, np.uint8).reshape(4, -1)
                out = totals.setdefault(t, np.zeros(planes.shape[1], np.int64))
                out += np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)
        for t, out in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([squeeze(done(out))], pa.binary())], ["t", "n"])

    return total


def _whole(seen: DataFrame, contexts: int, size: int, dtype, done) -> np.ndarray:
    """A broadcast's tables, of fixed size, from the ranges that partitions counted."""
    out = np.zeros((contexts * RANGES, size // RANGES), dtype)
    for r in seen.repartition(len(out), "t").mapInArrow(_total(done), "t int, n binary").collect():
        out[r["t"]] = unsqueeze(r["n"], dtype)
    return out.reshape(contexts, size)


def _features(bit: np.ndarray, slots: list[np.ndarray], tables: np.ndarray, own: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """(log-odds by context, gate); own: the weight of each bit's own word, to be left out."""
    odds, levels = [], []
    for k, slot in enumerate(slots):
        pair = tables[k].view(np.complex64).take(slot, mode="wrap")  # zeros and ones in one look-up
        zeros, ones = pair.real, pair.imag
        if own is not None:
            zeros, ones = np.maximum(0, zeros - own[0]), np.maximum(0, ones - own[1])
        odds.append(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))))
        if k in (len(slots) - 3, len(slots) - 1):
            levels.append(np.minimum(LEVELS - 1, ((zeros + ones + 1).view(np.int32) >> 23) - 127).astype(np.int64))
    return odds, levels[-1] * LEVELS + levels[0]


def _mixed(odds: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = odds[0] * weights[0].take(gate, mode="wrap")
    for k in range(1, len(odds)):
        x += odds[k] * weights[k].take(gate, mode="wrap")
    return np.clip(x, -12, 12)


def _step(x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Cell of the adaptive probability map: the log-odds in steps, by the level of the longest context."""
    return (gate // LEVELS) * APM_STEPS + np.round((x + 12) * ((APM_STEPS - 1) / 24)).astype(np.int64)


def _shard(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, bytes, the word of each byte, the words' counts), block after block of so many words; the rows of a shard
    come in order of buckets, and blocks go on over rows."""
    held: list = [None, b"", np.zeros(0, np.int64)]

    def full(last: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        while len(held[2]) >= blocks or (last and len(held[2])):
            data = np.frombuffer(held[1], np.uint8)
            ends = np.flatnonzero(data == 32)[:blocks] + 1
            counts, part = held[2][: len(ends)], data[: ends[-1]]
            yield held[0], part, np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends]))), counts
            held[1], held[2] = held[1][ends[-1] :], held[2][len(ends) :]

    for batch in batches:
        for shard, words, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "counts")), strict=True):
            if shard != held[0]:
                yield from full(True)
                held[0] = shard
            more, n = _kept(words, unsqueeze(counts, np.int64), lambda n: n > 0)
            held[1] += more
            held[2] = np.concatenate([held[2], n])
            yield from full(False)
    yield from full(True)


def _learn(shared):
    """Weights learned online over the words of each shard, with the mass behind them, and the map's counts."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        states: dict[int, tuple] = {}
        for shard, data, word, n in _shard(batches, SHARD_BLOCK):
            if shard not in states:
                states[shard] = np.full((len(CONTEXTS), GATES), 0.3, np.float32), np.zeros(GATES), np.zeros((2, LEVELS * APM_STEPS))
            weights, mass, cells = states[shard]
            weight = _weight(n).astype(np.float32)[word]
            once = (_weight(n) - _weight(n - 1)).astype(np.float32)[word]  # what one occurrence adds
            for bit, slots in _bits(data, _contexts(data, word)):
                own = once * bit.astype(np.float32)
                odds, gate = _features(bit, slots, tables, (once - own, own))
                x = _mixed(odds, gate, weights)
                cells += np.bincount(_step(x, gate) + bit * cells.shape[1], weights=weight, minlength=cells.size).reshape(2, -1)
                wrong = (bit.astype(np.float32) - 1 / (1 + np.exp(-x))) * weight
                total = np.bincount(gate, weights=weight, minlength=GATES)
                mass += total
                power = np.bincount(gate, weights=weight * sum(o * o for o in odds), minlength=GATES) + 1.0
                rate = (2.0 / (1 + 0.02 * mass / np.maximum(total, 1.0)) + 0.05) / power
                for k, o in enumerate(odds):
                    weights[k] += rate * np.bincount(gate, weights=wrong * o, minlength=GATES)
        for shard, state in states.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in state)], ["shard", "weights", "mass", "cells"])

    return learn


def _costs(words: bytes, counts: np.ndarray, tables: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 probability of each word's spelling."""
    out = []
    for data, word, n in _blocks(words, counts):
        told = np.ones(len(data))
        for bit, slots in _bits(data, _contexts(data, word)):
            odds, gate = _features(bit, slots, tables, None)
            x = _mixed(odds, gate, weights)
            p = 0.5 / (1 + np.exp(-x)) + 0.5 * refined.take(_step(x, gate), mode="wrap")
            told *= np.where(bit, p, 1 - p)
        total = np.bincount(word, weights=np.log10(told), minlength=len(n))
        out.append(total)
    return np.concatenate(out) if out else np.zeros(0)


def _answer(shared):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, (weights, refined, before) = (s.value for s in shared)
        for batch in batches:
            for b, words, counts, groups, spots, lines in zip(*(batch.column(c).to_pylist() for c in ("b", "words", "counts", "groups", "spots", "line_counts")), strict=True):
                n = unsqueeze(counts, np.int64)
                cost, places = np.zeros(len(n), np.float32), np.zeros(len(n), np.uint32)
                cost[n < 2] = _costs(*_kept(words, n, lambda n: n < 2), tables, weights, refined)
                classes = wordbits.class_of(n)
                by = np.argsort(classes, kind="stable")
                first = np.searchsorted(classes[by], np.arange(wordbits.CLASSES))
                places[by] = (np.arange(len(n)) + (before[b] - first)[classes[by]]) * (classes[by] > 0)
                at = [unpack_rising(s).astype(np.int64) for s in spots]
                told = ([squeeze(v[x]) for x in at] for v in (n, places, cost))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b] * len(groups), pa.int32()), pa.array(groups, pa.int32()), *(pa.array(t, pa.binary()) for t in told), pa.array(lines, pa.binary())],
                    [c.split()[0] for c in TELL.split(", ")],
                )

    return answer


def _cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each row's stretch of values as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64) * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))])


def _together(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """What _cut took apart: (values of all rows, where each row begins)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), (at - at[0]) // size


def _encode(buckets: int, parts: int, part: int, tokens: int, types: int, once: int, twice: int):
    """A group's documents as CODED rows."""
    seen_once = 2 * twice / (2 * twice + once) if twice else 0.0  # of a held-out document's words to be spelled

    def encode(table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(table, False)
        held = np.array([held_out(i, parts, part) for i in group.ids], bool)
        counts, places, costs = np.zeros(len(group.words), np.int64), np.zeros(len(group.words), np.uint32), np.zeros(len(group.words))
        line_counts = np.zeros(len(group.lines), np.int64)
        answers = {b: x for b, *x in zip(*(told[n].to_pylist() for n in ("b", "counts", "places", "costs", "line_counts")), strict=True)}
        for b, mine, whose in group.buckets(buckets):
            counts[mine] = unsqueeze(answers[b][0], np.int64)
            places[mine] = unsqueeze(answers[b][1], np.uint32)
            costs[mine] = unsqueeze(answers[b][2], np.float32)
            line_counts[whose] = unsqueeze(answers[b][3], np.uint32)
        first = group.first

        def sums(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)

        base = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
        classes = wordbits.class_of(counts).astype(np.uint8)
        # a word to be spelled: a held-out document's may be one that was seen once, a training document's was not but for itself
        spelled = costs + np.log10(1 - seen_once)
        listed = np.log10(10.0**spelled + (counts == 1) * (seen_once / max(1, once)))
        away = np.flatnonzero(classes[group.token] == 0)
        out = np.where(held[group.doc[away]], listed[group.token[away]], spelled[group.token[away]]).astype(np.float32)
        # lines: a document's own are not counted for it
        doc = group.doc[group.begin]
        key = doc.astype(np.int64) * (len(group.lines) + 1) + group.line
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        others = line_counts[group.line] - np.where(held[doc], 0, own[inverse])
        lines = np.searchsorted(doc, np.arange(len(first)))
        token = places[group.token]
        columns = [
            pa.array(group.ids, pa.int64()),
            pa.array(held, pa.bool_()),
            one(table["__h"]),
            np.diff(first),
            sums((counts[group.token] > 0).astype(np.int64)),
            sums(base[group.token]),
            group.size,
            _cut(classes[group.token], first),
            _cut((token & np.uint32(0xFFFF)).astype(np.uint16), first),
            _cut((token >> np.uint32(16)).astype(np.uint16), first),
            _cut(out, np.searchsorted(away, first)),
            _cut((group.begin - first[doc]).astype(np.uint32), lines),
            _cut((group.stop - first[doc]).astype(np.uint32), lines),
            _cut(others.astype(np.uint32), lines),
        ]
        names = [x.split()[0] for x in CODED.split(", ")]
        return pa.table([c.cast(pa.binary()) if isinstance(c, pa.LargeBinaryArray) else c for c in columns], names)

    return encode


# ---------------------------------------------------------------- running text


def _running(batches: Iterator[pa.RecordBatch], coder: wordbits.Coder) -> Iterator[tuple[pa.RecordBatch, wordbits.Tokens, np.ndarray]]:
    """(documents, their tokens, where each document begins), a bounded number of tokens or one document at a time."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(batch.column("n_tokens").to_numpy())])
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + TOKENS_AT_ONCE, "right")) - 1)
            docs = batch.slice(lo, hi - lo)
            classes, first = _together(docs.column("classes"), np.uint8)
            low, high = (_together(docs.column(c), np.uint16)[0].astype(np.uint32) for c in ("low", "high"))
            learns = ~docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            yield docs, wordbits.Tokens(coder, classes, low | (high << np.uint32(16)), first, learns), first
            lo = hi


def _count_running(shared):
    """Counts of the contexts' slots over the training documents of a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        seen = np.zeros((wordbits.CONTEXTS, 2 << coder.table_bits), np.uint32)
        for _, tokens, _ in _running(batches, coder):
            tokens.count(seen)
        yield from _ranges(seen)

    return count


def _learn_running(shared):
    """Weights learned online over the running text of each shard."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tables = (s.value for s in shared)
        states: dict[int, wordbits.Learner] = {}

        def whole() -> Iterator[tuple[int, pa.RecordBatch]]:
            """Stretches of a shard's documents, cut by their tokens and not as batches come."""
            held, size, shard = [], 0, None
            for batch in batches:
                which, n = batch.column("shard").to_numpy(), batch.column("n_tokens").to_numpy()
                for k in range(len(batch)):
                    if held and (which[k] != shard or size + n[k] > TOKENS_AT_ONCE):
                        yield shard, pa.concat_batches(held)
                        held, size = [], 0
                    shard = which[k]
                    held.append(batch.slice(k, 1))
                    size += n[k]
            if held:
                yield shard, pa.concat_batches(held)

        for shard, docs in whole():
            for _, tokens, _ in _running(iter([docs]), coder):
                states.setdefault(int(shard), wordbits.Learner()).learn(tokens, tables)
        for shard, s in states.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (s.weights, s.mass, s.cells))], ["shard", "weights", "mass", "cells"])

    return learn


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _score(shared, weights: np.ndarray, refined: np.ndarray, tokens: int, lines: int, line_share: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tables = (s.value for s in shared)
        usual = max(1.0, tokens / max(1, lines))
        rate = line_share / usual  # of a line beginning at a token
        off = np.log10(1 - rate)
        for docs, text, first in _running(batches, coder):
            plain = wordbits.costs(text, tables, weights, refined)
            plain[text.classes == 0] += _together(docs.column("spelled"), np.float32)[0]
            (begin, at), (stop, _), (others, _) = (_together(docs.column(c), np.uint32) for c in ("begins", "stops", "others"))
            doc = np.repeat(np.arange(len(docs)), np.diff(at))
            begin, stop = begin + first[doc], stop + first[doc]
            upto = np.concatenate([[0.0], np.cumsum(plain)])
            words = upto[stop] - upto[begin]
            whole = np.log10(np.maximum(others, 1e-9) / max(1, lines))
            told_whole = 1 / (1 + 10.0 ** np.clip(words - whole - np.log10(max(line_share, 1e-9)), -300, 300)) * (others > 0)
            was_told = np.concatenate([[0.0], np.cumsum(told_whole)])
            nth = np.arange(len(doc)) - at[doc]
            now = (LINE_PRIOR * line_share + was_told[:-1] - was_told[at[doc]]) / (LINE_PRIOR + nth)
            now = np.clip(now / usual, 1e-9, 0.5)
            size = stop - begin
            spelled = words + size * np.log10(1 - now)
            whole = np.where(others > 0, whole + np.log10(now), -np.inf)
            top = np.maximum(spelled, whole)
            gain = top + np.log10(10.0 ** (spelled - top) + 10.0 ** (whole - top)) - words - size * off
            total = np.add.reduceat(plain + off, first[:-1]) + np.bincount(doc, weights=gain, minlength=len(docs))
            bits = -total * np.log2(10) / (docs.column("size").to_numpy() + 1)
            out = [docs.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            out += [pa.array(np.full(len(docs), tokens, np.int64)), docs.column("base_score"), pa.array(np.round(total, 4)), pa.array(np.round(bits, 6))]
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in SCORES.split(", ")])

    return score


def mixing_scores(docs: DataFrame, parts: int = 5, part: int = 1) -> DataFrame:
    """SCORES of docs (doc_id, text), learned from the documents whose crc32(doc_id as text) mod parts is not part.

    base_score: the add-a-half unigram model; score: the mixing model's log10 probability; bits_per_byte: the same by
    the bytes of the words, their separators and the end.  A null text is empty: its only token is the end.  A null
    doc_id counts as empty text.  Rows of one doc_id are documents of their own, and repeated rows are learned as often
    as they occur.  Where nothing is learned, every word is spelled by even bits.  Other columns are not carried.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = group_count(docs)
    buckets = SHARDS * -(-max(shuffle_partitions(spark), groups // 2) // SHARDS)  # each in one shard
    docs = docs.withColumn("__g", dealt(groups)).withColumn("__h", F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))))
    asks = docs.groupBy("__g").applyInArrow(_ask(buckets, parts, part), ASK)
    words = stash(asks.groupBy("b").applyInArrow(_gather, WORDS), "words")
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "lines", "lines_once"))).first()

    with small_batches(spark, 64):
        seen = words.select("words", "counts").mapInArrow(_count, "t int, n binary")
        tables = _whole(seen, len(CONTEXTS), 2 << TABLE_BITS, np.float32, lambda n: (n / 16).astype(np.float32))
    shared = spark.sparkContext.broadcast(tables)
    # a fixed number of shards of the range of hashes: what is learned does not depend on partitions, groups or buckets
    shards = words.select("b", "words", "counts", F.floor(F.col("b") * SHARDS / buckets).cast("int").alias("shard"))
    shards = shards.repartition("shard").sortWithinPartitions("shard", "b")
    learned = shards.mapInArrow(_learn(shared), "shard int, weights binary, mass binary, cells binary").collect()
    weights, mass = np.full((len(CONTEXTS), GATES), 1e-6 * 0.3), np.full(GATES, 1e-6)
    cells = np.zeros((2, LEVELS * APM_STEPS))
    for r in sorted(learned, key=lambda r: r["shard"]):  # a few kB a shard
        m = np.frombuffer(r["mass"])
        weights += np.frombuffer(r["weights"]).reshape(weights.shape) * m
        mass += m
        cells += np.frombuffer(r["cells"]).reshape(cells.shape)
    weights = np.round(weights / mass, 5).astype(np.float32)
    middle = 1 / (1 + np.exp(-np.tile(np.linspace(-12, 12, APM_STEPS), LEVELS)))
    refined = np.round(np.clip((cells[1] + 2 * middle) / (cells.sum(axis=0) + 2), 1e-6, 1 - 1e-6), 7)
    line_share = min(0.9, max(1e-6, (total["lines"] - total["lines_once"]) / max(1, total["lines"])))

    # words' codes: numbers of words and tokens by class; a word's place goes on from the buckets before
    rows = sorted(words.select("b", "sizes", "masses").collect(), key=lambda r: r["b"])
    sizes = np.array([unsqueeze(r["sizes"], np.int64) for r in rows], np.int64).reshape(-1, wordbits.CLASSES)
    masses = sum((unsqueeze(r["masses"], np.int64) for r in rows), np.zeros(wordbits.CLASSES, np.int64))
    before = {r["b"]: x for r, x in zip(rows, np.cumsum(sizes, axis=0) - sizes, strict=True)}
    coder = wordbits.Coder(sizes.sum(axis=0), masses)
    twice = int(coder.sizes[2])
    tells = words.mapInArrow(_answer((shared, spark.sparkContext.broadcast((weights, refined, before)))), TELL)
    encode = _encode(buckets, parts, part, total["tokens"], total["types"], total["once"], twice)
    coded = stash(docs.groupBy("__g").cogroup(tells.groupBy("g")).applyInArrow(encode, CODED), "coded")
    shared.destroy()  # what it answered is written

    # running text: contexts are counted, weights are learned, then all is scored
    learns = coded.where("not held_out")
    code = spark.sparkContext.broadcast(coder)
    with small_batches(spark, 64):
        seen = learns.select("held_out", "n_tokens", "classes", "low", "high").mapInArrow(_count_running(code), "t int, n binary")
        tables = _whole(seen, wordbits.CONTEXTS, 1 << coder.table_bits, np.uint16, wordbits.narrow)
    shared = code, spark.sparkContext.broadcast(tables)
    shards = max(SHARDS, total["tokens"] // SHARD_TOKENS)
    text = learns.select("held_out", "n_tokens", "classes", "low", "high", "h", "doc_id", F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    text = text.repartition(shards, "shard").sortWithinPartitions("shard", "h", "doc_id", "classes", "low", "high")
    learned = text.mapInArrow(_learn_running(shared), "shard int, weights binary, mass binary, cells binary").collect()
    learner = wordbits.Learner()
    weights, mass, cells = learner.weights * 1e-6, np.full(wordbits.GATES, 1e-6), learner.cells
    for r in sorted(learned, key=lambda r: r["shard"]):  # a few kB a shard
        m = np.frombuffer(r["mass"])
        weights = weights + np.frombuffer(r["weights"]).reshape(weights.shape) * m
        mass = mass + m
        cells = cells + np.frombuffer(r["cells"])
    weights = np.round(weights / mass, 5).astype(np.float32)
    return coded.mapInArrow(_score(shared, weights, wordbits.refine(cells), total["tokens"], total["lines"], line_share), SCORES)
