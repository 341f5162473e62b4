"""Bit predictors over running text, mixed logistically.

A token is told in bits: whether it is unknown (an escape; it is then spelled, see mixmodel), the class of its count (half
octaves, a Huffman code over the classes' tokens), its place among the words of that class.  Each bit is predicted where
the token stands, from the node of the code that has been reached and

* the words' counts below the node (of no context: classes' tokens, then numbers of words, which have about equal counts),
* what followed the word before at this node,
* what followed the two words before at this node,
* for the first bit, the share of unknown words that the document had so far.

The contexts' counts are hashed tables of about a pair a training token, `2**TABLE_BITS` pairs at most, filled from all
training tokens; a training token's own occurrence is left out wherever it is predicted.  Pairs are read as states: both
counts in steps (exact up to EXACT), whose log-odds are looked up.  A gate - the kind of bit and how often both contexts
were seen there - picks the weights of the log-odds.  Weights are learned online, block after block of running text, and an adaptive
probability map corrects what is mixed.

All log-odds are those of the way the token went, so a bit's value needs no case of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from paralex.llm.common import U, mix

#: Of a context's table, at least and at most.
LEAST_BITS = 12
TABLE_BITS = 22
CONTEXTS = 2
INPUTS = CONTEXTS + 2
CLASSES = 128
LEVELS = 8
KINDS = 3  # the escape, a class's bit, a place's bit
GATES = KINDS * LEVELS * LEVELS
APM_STEPS = 33
BLOCK = 16_384
#: Tokens that the corpus' share of unknown words counts as, against a document's own.
PRIOR = 50.0
#: Bits that one look-up of a context's line of pairs serves.
NEAR = 5
START = U(1) << U(63)  # stands before a text


def class_of(counts: np.ndarray) -> np.ndarray:
    """0 for words to be spelled (seen once or never), else half octaves."""
    return np.where(counts > 1, np.minimum(CLASSES - 1, np.floor(2 * np.log2(np.maximum(counts, 1)))), 0).astype(np.int64)


class Coder:
    """The code of words (class, place), from the classes' numbers of words and of tokens; class 0 is the escape."""

    def __init__(self, sizes: np.ndarray, masses: np.ndarray):
        self.sizes = sizes
        self.table_bits = min(TABLE_BITS, max(LEAST_BITS, int(masses.sum()).bit_length()))
        paths: dict[int, list[tuple[int, float]]] = {int(c): [] for c in np.flatnonzero(sizes) if c}
        heap = [(int(masses[c]), c, [c]) for c in paths]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for bit, (own, _, members), (other, _, _) in ((0, a, b), (1, b, a)):
                for c in members:
                    paths[c].append((bit, np.log((own + 0.5) / (other + 0.5))))
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        known, unknown = int(masses[1:].sum()), int(masses[0])
        self.unknown = (unknown + 0.5) / (known + unknown + 1)
        first = float(np.log((1 - self.unknown) / self.unknown))
        self.path, self.steps, self.width = (np.zeros(CLASSES, np.int64) for _ in range(3))
        self.path[0], self.steps[0] = 1, 1
        for c, path in paths.items():
            code = 0  # the bit of known words
            for bit, _ in reversed(path):
                code = code * 2 + bit
            self.path[c], self.steps[c], self.width[c] = code, 1 + len(path), int(sizes[c] - 1).bit_length()
        #: By place of a bit, then by class: log-odds by counts of words alone, where the way left that of the class's last
        #: word before (both sides hold as many words), leaves it there, or is on it still.
        self.odds = np.zeros((int((self.steps + self.width).max()), 3, CLASSES), np.float32)
        self.odds[0, 2, 0] = -first
        for c, path in paths.items():
            self.odds[0, 2, c] = first
            self.odds[1 : self.steps[c], 2, c] = [odds for _, odds in reversed(path)]
            for d in range(self.width[c]):
                left = int(self.width[c]) - d - 1
                on = (int(sizes[c] - 1) >> left) << left
                sides = [min(max(int(sizes[c]) - x, 0), 1 << left) + 0.02 for x in (on, on ^ (1 << left))]
                self.odds[self.steps[c] + d, 2, c] = np.log(sides[0] / sides[1])
                self.odds[self.steps[c] + d, 1, c] = np.log(sides[1] / sides[0])
        self.odds = self.odds.reshape(len(self.odds), -1)

    def code(self, classes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, from the highest of 64 bits down; how many bits they share with their class's last word)."""
        width = self.width[classes]
        size = self.steps[classes] + width
        code = ((self.path[classes] << width) | places).astype(U) << (64 - size).astype(U)
        apart = np.frexp((places ^ np.maximum(self.sizes[classes] - 1, 0)).astype(np.float64))[1]  # bits from the first that differs
        return code, np.where(classes > 0, size - apart, size)


class Tokens:
    """Tokens of texts one after the other: class, place, whether the text begins there, whether it is a training text."""

    def __init__(self, coder: Coder, classes: np.ndarray, places: np.ndarray, first: np.ndarray, learns: np.ndarray):
        self.coder, self.classes, self.places = coder, classes.astype(np.int64), places.astype(np.int64)
        word = (classes.astype(U) << U(40)) | places.astype(U)
        n = len(word)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin = first[:-1]
        before = np.concatenate([[START], word[:-1]])[:n]
        before[begin[begin < n]] = START
        two = np.concatenate([[START], before[:-1]])[:n]
        two[begin[begin < n]] = START
        self.word = word
        self.contexts = [(h >> U(32)).astype(np.uint32) for h in (mix(before + U(0x51)), mix(mix(before + U(0xA7)) + two))]
        self.own = learns[doc]
        gone = np.concatenate([[0], np.cumsum(classes == 0)])
        share = (PRIOR * coder.unknown + gone[:-1] - gone[begin][doc]) / (PRIOR + np.arange(n) - begin[doc])
        share = np.clip(share, 1e-6, 1 - 1e-6)
        self.drift = (np.log(share / (1 - share)) * np.where(classes == 0, 1, -1)).astype(np.float32)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(tokens, those of longest codes first; their classes; lengths; contexts)."""
        for lo in range(0, len(self.word), BLOCK):
            classes = self.classes[lo : lo + BLOCK]
            size = self.coder.steps[classes] + self.coder.width[classes]
            by = np.argsort((64 - size).astype(np.uint8), kind="stable")
            at = by + lo
            yield at, classes[by], size[by], [c[at] for c in self.contexts]

    def slots(self, code: np.ndarray, size: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each place of a bit: (how many of the tokens have one, the bits, for each context the slots of their pairs).
        A context's hash is made for a node and NEAR bits below it, whose pairs are near each other in memory."""
        right = np.uint32(32 - self.coder.table_bits)
        many = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        node = np.full(len(code), 0x9E3779B9, np.uint32)
        below = np.zeros(len(code), np.int64)
        for j, m in enumerate(many):
            if j % NEAR == 0:
                node = (node[:m] + below[:m].astype(np.uint32)) * np.uint32(0xC2B2AE35)
                starts = []
                for c in contexts:
                    h = c[:m] ^ node
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x85EBCA6B)
                    h >>= right
                    starts.append(h.astype(np.int64))
                below = np.ones(m, np.int64)
            below = below[:m]
            bit = ((code[:m] >> U(63 - j)) & U(1)).view(np.int64)
            yield m, bit, [s[:m] ^ below for s in starts]
            below = below << 1
            below |= bit

    def count(self, seen: np.ndarray) -> None:
        """The training tokens' bits are added to seen (CONTEXTS x 2**(table_bits + 1))."""
        for at, classes, size, contexts in self.blocks():
            code, _ = self.coder.code(classes, self.places[at])
            for _, bit, slots in self.slots(code, size, contexts):
                for k, slot in enumerate(slots):
                    slot <<= 1
                    slot |= bit
                    np.add.at(seen[k], slot, np.uint32(1))

    def bits(self, tables: np.ndarray) -> Iterator[tuple[np.ndarray, Iterator[tuple[int, list[np.ndarray], np.ndarray]]]]:
        """Block after block: (tokens, bit after bit (how many of the tokens, log-odds by input, gate))."""
        for at, classes, size, contexts in self.blocks():
            yield at, self._bits(tables, at, classes, size, contexts)

    def _bits(self, tables, at, classes, size, contexts):
        code, shared = self.coder.code(classes, self.places[at])
        shared = (shared + 1).astype(np.int16)
        steps, own, kind = self.coder.steps[classes].astype(np.uint8), self.own[at].astype(np.uint16), classes.astype(np.int16)
        for j, (m, bit, slots) in enumerate(self.slots(code, size, contexts)):
            which = np.clip(shared[:m] - np.int16(j), 0, 2)
            which *= np.int16(CLASSES)
            which += kind[:m]
            odds = [self.coder.odds[j].take(which, mode="wrap")]
            gate = np.zeros(m, np.int16) if j == 0 else (steps[:m] <= j) * np.int16(LEVELS * LEVELS) + np.int16(LEVELS * LEVELS)
            way = bit.astype(np.uint16)
            way <<= np.uint16(1)
            way |= own[:m]
            for k, slot in enumerate(slots):
                state = tables[k].take(slot, mode="wrap")
                state |= way
                value = VALUES.take(state.astype(np.int64), mode="wrap")
                level = value & np.int16(LEVELS - 1)
                if k:
                    level *= np.int16(LEVELS)
                gate += level
                value >>= np.int16(3)
                value = value.astype(np.float32)
                value *= np.float32(1 / ODDS_STEPS)
                odds.append(value)
            if j == 0:
                odds.append(self.drift[at])  # the document's share is for the first bit
            yield m, odds, gate.astype(np.int64)


#: Steps that a count is told in: one by one, then in eighths of an octave.
STEPS = 128
EXACT = 16
ODDS_STEPS = 300


def _values() -> np.ndarray:
    """By state (pair of steps, bit, whether the token's own occurrence is left out): log-odds of the bit, in
    ODDS_STEPS to a unit, times LEVELS, and the level, for the gate."""
    value = np.where(np.arange(STEPS) < EXACT, np.arange(STEPS), EXACT * 2.0 ** ((np.arange(STEPS) - EXACT) / 8))
    ones, zeros, bit, own = np.meshgrid(value, value, [0, 1], [0, 1], indexing="ij")
    went, other = np.maximum(np.where(bit, ones, zeros) - own, 0), np.where(bit, zeros, ones)
    level = np.minimum(np.floor(np.log2(went + other + 1)), LEVELS - 1)
    return (np.round(np.log((went + 0.4) / (other + 0.4)) * ODDS_STEPS) * LEVELS + level).astype(np.int16).reshape(-1)


VALUES = _values()


def narrow(seen: np.ndarray) -> np.ndarray:
    """Pairs of counts as states, four times their number; a pair that is too large is scaled as one."""
    pairs = seen.reshape(-1, 2)
    most = EXACT * 2.0 ** ((STEPS - 1 - EXACT) / 8)
    pairs = pairs / np.maximum(1.0, pairs.max(axis=1) / most)[:, None]
    step = np.where(pairs < EXACT, np.ceil(pairs), EXACT + np.round(8 * np.log2(np.maximum(pairs, EXACT) / EXACT))).astype(np.uint16)
    return (step[:, 1] * np.uint16(STEPS) + step[:, 0]) * np.uint16(4)


#: What a gate adds to the number of a cell of the adaptive probability map: the log-odds in steps, by the gate's first part.
CELL = (np.arange(GATES) // LEVELS * APM_STEPS + 0.5 + (APM_STEPS - 1) / 2).astype(np.float32)


def mixed(odds: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mixed log-odds, cells of the map)."""
    x = weights[0].take(gate, mode="wrap")
    x *= odds[0]
    for k in range(1, len(odds)):
        w = weights[k].take(gate, mode="wrap")
        w *= odds[k]
        x += w
    np.minimum(x, np.float32(15), out=x)
    np.maximum(x, np.float32(-15), out=x)
    cell = x * np.float32((APM_STEPS - 1) / 30)
    cell += CELL.take(gate, mode="wrap")
    return x, cell.astype(np.int64)


def mirrored(cells: np.ndarray) -> np.ndarray:
    """Cells of the other way."""
    return cells.reshape(*cells.shape[:-1], -1, APM_STEPS)[..., ::-1].reshape(cells.shape)


class Learner:
    """Weights (INPUTS x GATES), the mass behind each gate, and how often the map's cells were met."""

    def __init__(self):
        self.weights = np.tile(np.array([[0.8], [0.2], [0.2], [0.2]], np.float32), (1, GATES))
        self.mass = np.zeros(GATES)
        self.cells = np.zeros(KINDS * LEVELS * APM_STEPS)

    def learn(self, tokens: Tokens, tables: np.ndarray) -> None:
        for _, bits in tokens.bits(tables):
            for _, odds, gate in bits:
                x, cell = mixed(odds, gate, self.weights)
                self.cells += np.bincount(cell, minlength=len(self.cells))
                np.exp(x, out=x)
                x += 1
                wrong = 1 / x
                total = np.bincount(gate, minlength=GATES)
                self.mass += total
                power = odds[0] * odds[0]
                for o in odds[1:]:
                    power += o * o
                power = np.bincount(gate, weights=power, minlength=GATES) + 1.0
                rate = (2.0 / (1 + 0.02 * self.mass / np.maximum(total, 1)) + 0.05) / power
                for k, o in enumerate(odds):
                    self.weights[k] += rate * np.bincount(gate, weights=wrong * o, minlength=GATES)


def refine(cells: np.ndarray) -> np.ndarray:
    """Probability of the way taken, by cell."""
    middle = np.tile(1 / (1 + np.exp(-np.linspace(-15, 15, APM_STEPS))), KINDS * LEVELS)
    out = np.round(np.clip((cells + 2 * middle) / (cells + mirrored(cells) + 2), 1e-6, 1 - 1e-6), 7)
    return ((out + 1 - mirrored(out)) / 2).astype(np.float32)


def costs(tokens: Tokens, tables: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 probability of each token's code."""
    out = np.zeros(len(tokens.word))
    half = refined * np.float32(0.5)
    for at, bits in tokens.bits(tables):
        told = np.ones(len(at))  # at least 1e-6 a bit, so that a whole code's stays a number
        for m, odds, gate in bits:
            x, cell = mixed(odds, gate, weights)
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            np.divide(np.float32(0.5), x, out=x)
            x += half.take(cell, mode="wrap")
            told[:m] *= x
        out[at] = np.log10(told)
    return out
