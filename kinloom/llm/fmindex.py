"""FM-index over the words of many texts: backward search, located by sampled suffix positions.

Symbols are whole numbers; 0 separates stretches of text. Separators are taken as
different from each other, in text order, so that no comparison of suffixes runs from one
stretch into the next, whatever repeats. The first symbol of each stretch is sampled, so
that a walk to a sampled position never has to pass a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8  # every eighth position of a stretch is sampled


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of the suffixes of ``text`` in ascending order; text[-1] is 0 and all symbols are below 2**bits.

    The first sort is by as many symbols as fit one word; ties that go on are then split by
    the ranks of what follows, doubling the length compared each time.
    """
    n = len(text)
    known = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)  # no separator among the symbols taken so far
    for k in range(known):
        key <<= bits
        if k >= n:
            continue
        seen = text[k:][open_[: n - k]]
        key[: n - k][open_[: n - k]] += seen
        open_[n - k :] = False
        open_[: n - k] &= text[k:] > 0
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    tied = ~fresh
    tied[:-1] |= tied[1:]
    rows = np.flatnonzero(tied)
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    # tied suffixes in text order: right at once for those that met a separator
    packed = np.sort((group[rows] << 32) | order[rows])
    order[rows] = packed & 0xFFFFFFFF
    rank = np.empty(n, dtype=np.int64)
    places = np.arange(n)
    going = np.zeros(n, dtype=bool)
    going[rows] = open_[order[rows]]
    rank[order] = np.where(going, first[group], places)
    rows, reach = np.flatnonzero(going), known
    while len(rows):
        at = order[rows]
        packed = (rank[at] << 32) | rank[at + reach]
        by = np.argsort(packed, kind="stable")
        at, packed = at[by], packed[by]
        order[rows] = at
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = packed[1:] != packed[:-1]
        rank[at] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        tied = ~fresh
        tied[:-1] |= tied[1:]
        rows, reach = rows[tied], reach * 2
    return order


class WaveletTree:
    """Rank and access on a sequence of symbols below 2**bits, one bit vector a level, the highest bit first.

    Kept as a wavelet matrix: every level sorts the sequence stably by its bit, zeros first.
    A level is packed 64 bits a word, with the number of ones before each word.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        now = symbols
        for level in range(bits - 1, -1, -1):
            ones = ((now >> level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            before = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before, self.n - int(ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & below)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbols[i] occurs before place at[i]."""
        low, high = np.zeros(len(symbols), dtype=np.int64), at.astype(np.int64)
        for level, (packed, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            bit = ((symbols >> level) & 1).astype(bool)
            ones_low, ones_high = self._ones(packed, before, low), self._ones(packed, before, high)
            low = np.where(bit, zeros + ones_low, low - ones_low)
            high = np.where(bit, zeros + ones_high, high - ones_high)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before that place."""
        low, high = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        symbols = np.zeros(len(at), dtype=np.int64)
        for packed, before, zeros in self.levels:
            bit = (packed[high >> 6] >> (high & 63).astype(np.uint64)) & np.uint64(1) > 0
            ones_low, ones_high = self._ones(packed, before, low), self._ones(packed, before, high)
            low = np.where(bit, zeros + ones_low, low - ones_low)
            high = np.where(bit, zeros + ones_high, high - ones_high)
            symbols = (symbols << 1) | bit
        return symbols, high - low


class FMIndex:
    """Index of ``text``, whose symbols are 0 for separators or below ``size``."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        bits = max(1, int(size - 1).bit_length())
        order = suffix_array(text, bits)
        self.n, self.size = len(text), size
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.tree = WaveletTree(text[order - 1], bits)
        ends = np.flatnonzero(text == 0)
        starts = np.zeros(self.n, dtype=np.int64)  # where the stretch of a place starts
        starts[ends[:-1] + 1] = ends[:-1] + 1
        starts = np.maximum.accumulate(starts)
        sampled = ((order - starts[order]) % SAMPLE == 0) & (text[order] > 0)
        self.sampled, self.samples = sampled, order[sampled].astype(np.int32)
        self.nth_sample = np.cumsum(sampled, dtype=np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase (a row of symbols, none of them 0) the rows [low, high) of the suffixes it begins."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[alive, column].astype(np.int64)
            both = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([low[alive], high[alive]]))
            low[alive] = self.before[symbols] + both[: len(alive)]
            high[alive] = self.before[symbols] + both[len(alive) :]
            empty = low[alive] >= high[alive]
            high[alive[empty]] = low[alive[empty]]
            alive = alive[~empty]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of the suffixes at ``rows``: steps back until a sampled one is met."""
        places = np.empty(len(rows), dtype=np.int64)
        walking, at = np.arange(len(rows)), rows.astype(np.int64)
        for steps in range(SAMPLE):
            met = self.sampled[at]
            places[walking[met]] = self.samples[self.nth_sample[at[met]] - 1] + steps
            walking, at = walking[~met], at[~met]
            if not len(walking):
                break
            symbols, earlier = self.tree.access(at)
            at = self.before[symbols] + earlier
        return places
