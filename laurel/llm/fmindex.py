"""A compressed full-text index over a sequence of numbers, in numpy.

The Burrows-Wheeler transform is kept in a wavelet matrix: one bit per symbol and level, packed,
with a running count per 64 bits. Backward search runs for many patterns at once: each step
narrows all their intervals by one symbol to the left.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        self.words = np.packbits(
            np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little"
        ).view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank of any symbol before any position of a sequence."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, BitVector]] = []
        first = np.arange(symbols)
        at = np.zeros(symbols, np.int64)
        for level in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            vector = BitVector(bit)
            self.levels.append((level, vector))
            values = np.concatenate([values[~bit], values[bit]])
            at = self._step(vector, first >> level & 1, at)
        #: where the block of each symbol begins after the last level
        self.begin = at

    @staticmethod
    def _step(vector: BitVector, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = vector.rank(at)
        return np.where(bit, vector.zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = self.begin[symbol]
        for level, vector in self.levels:
            at = self._step(vector, symbol >> level & 1, at)
        return at - block


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols, by prefix doubling."""
    rank, have = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        ahead = np.full(len(text), -1, np.int64)
        ahead[:-have] = rank[have:]
        key = rank * (int(rank.max()) + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        have *= 2
        if new.all():
            break
    return order


class FMIndex:
    """Index over symbols 1 .. symbols - 1; 0 ends a piece. Patterns are at most ``depth`` long."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int) -> None:
        order = suffix_order(text, depth)
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def search(self, text: np.ndarray, ends: np.ndarray, length: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the patterns that end before ``ends`` in ``text``, up to
        ``length``: (length matched more than once, low, high). A pattern is followed to the left
        until it has one occurrence left or is ``length`` long; (low, high) is its interval then.
        """
        symbol = text[ends - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        matched = np.ones(len(ends), np.int64)
        live = np.flatnonzero(high - low > 1)
        for step in range(2, length + 1):
            if not len(live):
                break
            symbol = text[ends[live] - step]
            both = np.concatenate([low[live], high[live]])
            moved = self.bwt.rank(np.tile(symbol, 2), both) + np.tile(self.first[symbol], 2)
            low[live], high[live] = moved[:len(live)], moved[len(live):]
            matched[live] = step
            live = live[high[live] - low[live] > 1]
        return matched, low, high
