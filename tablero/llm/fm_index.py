"""A compressed full-text index over whole-number symbols: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Suffixes are ordered by their first ``DEPTH`` symbols, which is all that backward search for patterns up to that length needs. Searches run
in lockstep: one numpy call advances every pattern by a symbol.
"""

from __future__ import annotations

import numpy as np

#: Longest pattern that can be searched.
DEPTH = 64


class Bits:
    """A bit vector packed into 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Index:
    """Counts how often patterns occur in a text of symbols 0 .. n; 0 separates and is never part of a pattern. ``weights`` says for each position how
    often its part of the text stands (once, if left out): a part that occurs many times is indexed once."""

    def __init__(self, text: np.ndarray, weights: np.ndarray | None = None):
        n = len(text)
        self.size = n
        order = self._suffixes(text)
        own = np.ones(n, dtype=np.int64) if weights is None else weights[order]
        self.weight = np.concatenate([[0], np.cumsum(own)])
        last = np.where(order > 0, text[order - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1))]).astype(np.int64)
        self.levels: list[Bits] = []
        self.depth = max(1, int(text.max(initial=0)).bit_length())
        row = last
        for level in range(self.depth - 1, -1, -1):
            bit = ((row >> level) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        symbols = np.arange(len(self.first) - 1)
        self.base = self._descend(symbols, np.zeros(len(symbols), dtype=np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Positions in the order of their suffixes' first DEPTH symbols, by prefix doubling."""
        rank, span, n = text.astype(np.int64), 1, len(text)
        while span < DEPTH:
            after = np.zeros(n, dtype=np.int64)
            if span < n:
                after[:-span] = rank[span:] + 1
            found, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
            span *= 2
            if len(found) == n:
                break
        return np.argsort(rank, kind="stable")

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position of the transform lands after following a symbol's bits down the matrix."""
        for level, bits in enumerate(self.levels):
            ones = bits.rank(at)
            high = (symbols >> (self.depth - 1 - level)) & 1 == 1
            at = np.where(high, bits.zeros + ones, at - ones)
        return at

    def back(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of the patterns with one more symbol in front."""
        both = self._descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        moved = both - np.concatenate([self.base[symbols]] * 2) + np.concatenate([self.first[symbols]] * 2)
        return moved[: len(symbols)], moved[len(symbols) :]

    def matches(self, text: np.ndarray, ends: np.ndarray, length: int | np.ndarray, least: int = 2, at_once: int = 1 << 16) -> np.ndarray:
        """Matching statistics up to ``length`` (of each): for each end position of the streamed text how many symbols up to it
        occur at least ``least`` times in the index as they stand, each occurrence by its weight."""
        out = np.zeros(len(ends), dtype=np.int64)
        limits = np.broadcast_to(length, len(ends))
        for begin in range(0, len(ends), at_once):
            own, limit = ends[begin : begin + at_once], limits[begin : begin + at_once]
            alive = np.flatnonzero(limit > 0)
            symbols = text[own[alive]]
            low, high = self.first[symbols], self.first[symbols + 1]
            for step in range(1, int(limit.max(initial=0)) + 1):
                keep = self.weight[high] - self.weight[low] >= least
                alive, low, high = alive[keep], low[keep], high[keep]
                out[begin + alive] += 1
                more = limit[alive] > step
                alive, low, high = alive[more], low[more], high[more]
                if not len(alive):
                    break
                low, high = self.back(text[own[alive] - step], low, high)
        return out
