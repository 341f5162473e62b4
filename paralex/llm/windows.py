"""Repeated windows of consecutive words or lines, found over the whole corpus and removed after their first place.

``substring_dedup`` hashes every window of ``width`` words (Rabin-Karp, from prefix sums) and counts the hashes in
Spark; ``line_dedup`` does the same with overlapping windows of three lines.  A window that also starts earlier is
repeated; repeated windows merge into maximal removal intervals.

Plan: documents are dealt into groups by a hash of doc_id.  Each group sends every distinct window hash once, with its
first place in the group, to the bucket of the hash; the bucket finds each hash's first place overall and answers the
other groups; each group then knows which of its windows start later.  Two shuffles, of 9 bytes a window and of the text.

Windows are told apart by two independent hashes: all 64 bits of the first, and 8 bits of the second with its bucket (so
72 bits and the logarithm of the number of buckets, which grows with the corpus).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import (
    SMALL_GROUP_BYTES,
    SPACE,
    Texts,
    U,
    dealt,
    give_back,
    group_count,
    one,
    pack_rising,
    passes,
    run_hashes,
    shuffle_partitions,
    squeeze,
    unpack_rising,
    unsqueeze,
)

NULL_ID = -(1 << 63)
SECOND = 0x2545F4914F6CDD1D
ASK_PARTS = ("hashes", "checks", "places", "ids", "counts", "starts")
ASK = "b int, g int, " + ", ".join(f"{n} binary" for n in ASK_PARTS)
ASK_ARROW = pa.schema([("b", pa.int32()), ("g", pa.int32()), *((n, pa.binary()) for n in ASK_PARTS)])
TELL = "g int, places binary"
TELL_ARROW = pa.schema([("g", pa.int32()), ("places", pa.binary())])


def _ordered(table: pa.Table) -> pa.Table:
    """A group's rows by doc_id, then text; a null doc_id comes first."""
    key = one(table["doc_id"]).fill_null(NULL_ID)
    table = table.append_column("__key", key).append_column("__text", one(table["text"]))
    return table.sort_by([("__key", "ascending"), ("__text", "ascending")])


def _windows(texts: pa.Array, lo: int, hi: int, unit: str, width: int) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of rows [lo, hi), the piece that each window starts at, the window's two hashes."""
    t = Texts(texts.slice(lo, hi - lo))
    t = t.words() if unit == "words" else t.lines()
    at = np.arange(max(0, len(t.starts) - width + 1))
    at = at[t.doc[at] == t.doc[at + width - 1]]
    if unit == "lines":  # windows of blank lines alone don't count
        filled = np.concatenate([[0], np.cumsum(~SPACE[t.data])])
        filled = np.concatenate([[0], np.cumsum(filled[t.ends] > filled[t.starts])])
        at = at[filled[at + width] > filled[at]]
    pieces = t.hashes()
    return t, at, run_hashes(pieces, at, at + width), run_hashes(pieces, at, at + width, SECOND)


class _Group:
    """All windows of a group of documents: their hashes, rows and starts, and which come first in the group."""

    def __init__(self, table: pa.Table, unit: str, width: int):
        table = _ordered(table)
        self.table, self.texts = table, one(table["__text"])
        self.ids = one(table["__key"]).to_numpy(zero_copy_only=False)
        parts = [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for lo, hi in passes(self.texts):
            t, at, h, second = _windows(self.texts, lo, hi, unit, width)
            doc = t.doc[at]
            parts.append((h, second, (doc + lo).astype(np.int32), (at - t.first[doc]).astype(np.int32)))
        h, second, self.row, self.start = (np.concatenate(x) for x in zip(*parts, strict=True))
        again = len(self.ids) > 1 and bool((self.ids[1:] == self.ids[:-1]).any())
        order, fresh = sorted_runs(h, second, (self.start, self.ids[self.row]) if again else ())
        self.hash, self.second, self.order, self.run = h, second, order, np.cumsum(fresh) - 1
        self.first = order[fresh]  # of each run, the earliest window

    def asks(self, g: int, buckets: int) -> pa.Table:
        first = np.sort(self.first)
        h, second = self.hash[first], self.second[first]
        bucket = ((second >> U(8)) % U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            mine = by[cuts[k] : cuts[k + 1]]
            docs, counts = np.unique(self.row[first[mine]], return_counts=True)
            nameless = first[mine][self.ids[self.row[first[mine]]] == NULL_ID]
            rows.append((int(k), g, h[mine].tobytes(), second[mine].astype(np.uint8).tobytes(), pack_rising(first[mine]), squeeze(self.ids[docs]), squeeze(counts.astype(np.uint32)), squeeze(self.start[nameless])))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ASK_ARROW, strict=True)], ASK_ARROW) if rows else ASK_ARROW.empty_table()

    def repeated(self, told: np.ndarray) -> np.ndarray:
        """A flag for each window: it also starts earlier, in the group or (told: first windows) elsewhere."""
        lead = self.first[self.run]
        here = (self.ids[self.row[self.order]] != self.ids[self.row[lead]]) | (self.start[self.order] > self.start[lead])
        there = np.zeros(len(self.hash), bool)
        there[told.astype(np.int64)] = True
        out = np.zeros(len(self.hash), bool)
        out[self.order] = here | there[lead]
        return out


def sorted_runs(h: np.ndarray, check: np.ndarray, then: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (h, check) lie together, within them by `then` (last key first, as lexsort has it) or as
    they come, and a flag where each run begins."""
    order = np.lexsort((*then, h)) if then else np.argsort(h, kind="stable")
    same, alike = h[order[1:]] == h[order[:-1]], check[order[1:]] == check[order[:-1]]
    if (same & ~alike).any():
        order = np.lexsort((*then, check, h))
        same, alike = h[order[1:]] == h[order[:-1]], check[order[1:]] == check[order[:-1]]
    fresh = np.ones(len(h), bool)
    fresh[1:] = ~(same & alike)
    return order, fresh


def _answers(rows: pa.Table) -> pa.Table:
    """Of one bucket: each group's windows that start earlier in another group (of smaller doc_id; of null ones, which
    several groups may hold, at a smaller start)."""
    parts = []
    for g, hashes, checks, places, ids, counts, starts in zip(*(rows[n].to_pylist() for n in ASK_ARROW.names[1:]), strict=True):
        doc = np.repeat(unsqueeze(ids, np.int64), unsqueeze(counts, np.uint32))
        start = np.zeros(len(doc), np.int32)
        start[doc == NULL_ID] = unsqueeze(starts, np.int32)
        parts.append((np.frombuffer(hashes, U), np.frombuffer(checks, np.uint8), doc, start, unpack_rising(places), np.full(len(doc), g, np.int32)))
    h, check, doc, start, place, g = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, fresh = sorted_runs(h, check)
    doc, start = doc[order], start[order]
    begins = np.flatnonzero(fresh)
    size = np.diff(np.append(begins, len(h)))
    least = np.repeat(np.minimum.reduceat(doc, begins), size)
    start = np.where(doc == NULL_ID, start, 0)
    soonest = np.repeat(np.minimum.reduceat(np.where(doc == least, start, np.iinfo(np.int32).max), begins), size)
    late = order[(doc > least) | (start > soonest)]
    late = late[np.lexsort((place[late], g[late]))]
    groups, cuts = np.unique(g[late], return_index=True)
    out = pa.table([pa.array(groups, pa.int32()), pa.array([pack_rising(place[x]) for x in np.split(late, cuts[1:])] if len(groups) else [], pa.binary())], TELL_ARROW)
    give_back()
    return out


def remove_repeats(docs: DataFrame, unit: str, width: int) -> DataFrame:
    """docs (doc_id, text, others) with n_units, n_removed, kept_text and spans.

    unit: words (kept ones joined by a space) or lines (joined by a line feed).  spans: removed units as [begin, end).
    A document with nothing to remove keeps its units all the same; a null text has none and gives an empty kept_text.
    Equal rows are told apart by nothing, so none counts as earlier than the other; rows that share a doc_id count as
    one document's.  A null doc_id comes before all others.  Columns named like the new ones are replaced.
    """
    new = ["n_units", "n_removed", "kept_text", "spans"]
    docs = docs.drop(*new)
    groups = group_count(docs, SMALL_GROUP_BYTES)
    buckets = max(shuffle_partitions(docs.sparkSession), groups // 4)
    docs = docs.withColumn("__g", dealt(groups))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        out = _Group(table, unit, width).asks(key[0].as_py(), buckets)
        give_back()
        return out

    # without other columns the two sides share one shuffle of the text
    asks = docs.select("doc_id", "text", "__g").groupBy("__g").applyInArrow(ask, ASK)
    tells = asks.groupBy("b").applyInArrow(_answers, TELL)
    kept = [f for f in docs.schema if f.name != "__g"]

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(table, unit, width)
        late = [unpack_rising(x) for x in told["places"].to_pylist()]
        flags = group.repeated(np.concatenate(late) if late else np.zeros(0, np.int64))
        units, removed, texts, spans = [], [], [], []
        for lo, hi in passes(group.texts):
            t = Texts(group.texts.slice(lo, hi - lo))
            t = t.words() if unit == "words" else t.lines()
            mine = flags & (group.row >= lo) & (group.row < hi)
            begin = t.first[group.row[mine] - lo] + group.start[mine]
            cover = np.zeros(len(t.starts) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + width, -1)
            gone = np.cumsum(cover)[:-1] > 0
            texts.append(t.joined(~gone, 32 if unit == "words" else 10))
            units.append(np.diff(t.first))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed.append(np.diff(total[t.first]))
            spans.append(_spans(t, gone))
        out = {f.name: group.table[f.name] for f in kept}
        if units:
            out |= {"n_units": np.concatenate(units), "n_removed": np.concatenate(removed), "kept_text": pa.chunked_array(texts), "spans": pa.chunked_array(spans)}
        else:
            out |= {"n_units": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.large_string()), "spans": pa.array([], SPANS)}
        out["kept_text"] = out["kept_text"].cast(pa.string())
        give_back()
        return pa.table(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += ", n_units long, n_removed long, kept_text string, spans array<struct<begin:int,end:int>>"
    return docs.groupBy("__g").cogroup(tells.groupBy("g")).applyInArrow(finish, schema)


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _spans(t: Texts, gone: np.ndarray) -> pa.Array:
    """Each document's maximal removed intervals."""
    prev = np.concatenate([[False], gone[:-1]])
    head = np.zeros(len(gone) + 1, bool)
    head[t.first] = True
    begin = np.flatnonzero(gone & (~prev | head[:-1]))
    nxt = np.concatenate([gone[1:], [False]])
    end = np.flatnonzero(gone & (~nxt | head[1:])) + 1
    base = t.first[t.doc[begin]]
    offsets = np.searchsorted(begin, t.first).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """Substring deduplication of docs (doc_id, text, others): remove_repeats() over words."""
    return remove_repeats(docs, "words", width)


def line_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """Line deduplication of docs (doc_id, text, others): remove_repeats() over overlapping windows of lines.

    Lines end at line feeds.  A window of blank lines alone is never repeated.
    """
    return remove_repeats(docs, "lines", width)
