"""Best-fit packing of tokenized documents into sequences of fixed length, by the sum-of-squares rule.

Tokenization.  Byte-level BPE never merges across a space between two words or around a lone line feed, so a text's ids
are its pieces' ids in a row.  Pieces are found with NumPy; each worker encodes a piece once and keeps its ids.

Packing.  Only lengths matter, so documents are cut and measured first; then items are dealt into blocks of some ten
thousand by a hash of their document, and every block is packed on its own: items go longest first, each to the gap
that makes the sum over gaps of the squared number of open sequences smallest, or to a new sequence where none fits.  A block leaves
few sequences open, whatever the size of the corpus, and the blocks' open sequences are few per ten thousand items.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import SPACE, Texts, one, passes, run_hashes, stash

BLOCK_ITEMS = 12_000
#: Distinct pieces of a generation; a worker keeps two, the newer and what is left of the older.
KEPT_PIECES = 1 << 19
ENCODED_AT_ONCE = 4096
#: A word behind a space, which can't join what stands beside it, nor be part of a special token; without lead bytes of
#: white space beyond ASCII.
PLAIN = re.compile(rb" [!-;=-~\x80-\xc1\xc3-\xe0\xe4-\xff]+")
#: Fixed value: how byte-level vocabularies write a space.
SPACE_MARK = "\u0120"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"


class _Store:
    """Token ids of pieces by the pieces' hashes: an open-addressing table that is probed for many hashes at once."""

    def __init__(self, most: int, dtype):
        self.most, self.n = most, 0
        self.mask = np.uint64((1 << int(np.ceil(np.log2(2 * most)))) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)  # 0: free
        self.spot = np.zeros(int(self.mask) + 1, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 13, dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, or -1."""
        out = np.full(len(keys), -1, np.int64)
        place = keys & self.mask
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[place[left]]
            hit = there == keys[left]
            out[left[hit]] = self.spot[place[left[hit]]]
            left = left[~hit & (there != 0)]
            place[left] = (place[left] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct keys that are not there yet, at most as many as there is room for."""
        end = int(self.at[self.n])
        if self.n + len(keys) >= len(self.at):
            self.at = np.resize(self.at, max(2 * len(self.at), self.n + len(keys) + 1))
        if end + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), end + len(ids)))
        self.at[self.n + 1 : self.n + len(keys) + 1] = end + np.cumsum(sizes)
        self.ids[end : end + len(ids)] = ids
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        place, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            at = place[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several for one place the last stays
            won = np.zeros(len(left), bool)
            won[free] = self.keys[at[free]] == keys[left[free]]
            self.spot[at[won]] = number[left[won]]
            left = left[~won]
            place[left] = (place[left] + np.uint64(1)) & self.mask

    def take(self, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these pieces in a row, where each begins and the end)."""
        size = self.at[spot + 1] - self.at[spot]
        to = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.at[spot] - to[:-1], size) + np.arange(to[-1])], to


class Encoder:
    """Token ids of many texts, through a store of pieces."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core already
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token.startswith(SPACE_MARK)]] = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.store, self.older = _Store(kept, self.dtype), None

    def _encoded(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(an order of the pieces, the ids of all in that order in a row, the number of each one's).

        Plain words behind a space are encoded together, as they would be in a text: each begins with the only id that
        begins with a space, which tells their ids apart.
        """
        plain = [PLAIN.fullmatch(x) is not None for x in pieces]
        some = [k for k, x in enumerate(plain) if x]
        other = [k for k, x in enumerate(plain) if not x]
        order: list[int] = []
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for k in range(0, len(some), ENCODED_AT_ONCE):  # an encoding holds much besides its ids
            mine = some[k : k + ENCODED_AT_ONCE]
            text = b"".join([pieces[j] for j in mine]).decode()
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            begins = np.flatnonzero(self.spaced[found])
            if len(begins) != len(mine) or begins[0]:
                other += mine  # not a tokenizer that keeps the space with the word
                continue
            order += mine
            ids.append(found)
            sizes.append(np.diff(np.append(begins, len(found))))
        for k in range(0, len(other), ENCODED_AT_ONCE):
            mine = other[k : k + ENCODED_AT_ONCE]
            texts = [pieces[j].decode("utf-8", "replace") for j in mine]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            order += mine
            ids.append(np.fromiter((i for x in found for i in x), self.dtype))
            sizes.append(np.array([len(x) for x in found], np.int64))
        return order, np.concatenate(ids), np.concatenate(sizes)

    def _spots(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The number in the store of each piece; unknown ones come from the older store, or are encoded."""
        spot = self.store.find(keys)
        missing = np.flatnonzero(spot < 0)
        if not len(missing):
            return spot
        fresh, first = np.unique(keys[missing], return_index=True)
        if self.store.n + len(fresh) > self.kept:
            distinct = len(fresh) + len(np.unique(spot[spot >= 0]))
            self.older, self.store = self.store, _Store(max(self.kept, distinct), self.dtype)
            return self._spots(keys, starts, ends, data)
        where = missing[first]
        if self.older is not None:
            old = self.older.find(fresh)
            ids, to = self.older.take(old[old >= 0])
            self.store.add(fresh[old >= 0], ids, np.diff(to))
            fresh, where = fresh[old < 0], where[old < 0]
        raw = data.tobytes()
        order, ids, sizes = self._encoded([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        self.store.add(fresh[order], ids, sizes)
        spot[missing] = self.store.find(keys[missing])
        return spot

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, the place in them where each text begins, and the end)."""
        data, n = t.data, len(t.data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(t.at), np.int64)
        head = np.zeros(n + 1, bool)
        head[t.at] = True
        high = data >= 0x80  # cuts keep away from white space beyond ASCII (lead bytes C2, E1 to E3)
        two = np.zeros(n, bool)
        two[1:] = high[1:] & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        before = SPACE[data] | (high & ~two)
        after = SPACE[data] | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
        solid = np.zeros(n, bool)
        solid[1:-1] = ~before[:-2] & ~after[2:] & ~head[1:-2] & ~head[2:-1]
        cut = head[:-1].copy()
        lone = np.flatnonzero(solid & ((data == 32) | (data == 10)))
        cut[lone] = True
        feeds = lone[data[lone] == 10]
        cut[feeds + 1] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys = np.maximum(run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends), np.uint64(1))
        spot = self._spots(keys, starts, ends, data)
        ids, to = self.store.take(spot)
        return ids, to[np.searchsorted(starts, t.at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_documents(docs: DataFrame, tokenizer: str, most: int, end_id: int) -> DataFrame:
    """PIECES of docs (doc_id, text): each document's ids and end_id, in one piece, or in pieces of `most` of which the
    first may be shorter.  item numbers the pieces of a batch; crc is of the piece's little-endian 32-bit ids."""

    def cut(batches):
        for batch in batches:
            texts, ids_column = one(batch.column("text")), batch.column("doc_id")
            texts = texts.cast(pa.large_string())
            for lo, hi in passes(texts):
                ids, at = encoder(tokenizer).encode(Texts(texts.slice(lo, hi - lo)))
                doc, piece, start, length, crc = [], [], [], [], []
                for k in range(hi - lo):
                    own = np.append(ids[at[k] : at[k + 1]].astype("<u4"), np.uint32(end_id))
                    head = len(own) % most or most
                    ends = list(range(min(head, len(own)), len(own) + 1, most))
                    for j, end in enumerate(ends):
                        begin = ends[j - 1] if j else 0
                        doc.append(lo + k)
                        piece.append(j)
                        start.append(begin)
                        length.append(end - begin)
                        crc.append(zlib.crc32(own[begin:end].tobytes()))
                out = [ids_column.take(pa.array(doc, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, range(len(doc))))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "item"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, packed in the given order."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for k, size in enumerate(lengths.tolist()):
        if size == capacity:
            sequence[k] = made
            made += 1
            continue
        # of moving a sequence from gap h to h - size (a full one is open no more); a new one only where none fits
        change = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        change[count[size:] == 0] = 1 << 62
        change[-1] = 1 << 61
        gap = size + int(np.argmin(change))
        if gap == capacity:
            sequence[k], offset[k] = made, 0
            made += 1
        else:
            sequence[k], offset[k] = open_by_gap[gap].pop(), capacity - gap
            count[gap] -= 1
        left = gap - size
        if left:
            open_by_gap[left].append(int(sequence[k]))
            count[left] += 1
    return sequence, offset


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of docs (doc_id, text): PIECES without item, with sequence_id and offset.

    A null or empty text is its end_id alone.  Repeated rows and null doc_ids are documents of their own, each packed
    (pieces then share doc_id and piece).  An empty table gives no rows.  Other columns are not carried.
    """
    pieces = stash(cut_documents(docs, tokenizer, capacity, end_id), "packing")
    blocks = max(1, -(-pieces.count() // BLOCK_ITEMS))
    # pieces of one document go together only by chance: a long document doesn't fill a block
    pieces = pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "item"), F.lit(blocks)))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = sum_of_squares(one(table["length"]).to_numpy(), capacity)
        table = table.drop_columns(["item", "__block"])
        return table.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    return pieces.groupBy("__block").applyInArrow(pack, PIECES.replace(", item long", "") + ", sequence_id long, offset long")
