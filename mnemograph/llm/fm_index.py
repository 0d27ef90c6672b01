"""An FM-index over word ids: suffix order, wavelet-matrix ranks, sampled positions.

All steps work on whole numpy arrays, so that a task indexes and searches one shard of a
corpus in a few vectorised passes.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order.

    ``symbols`` are non-negative; every 0 is a separator that differs from every other 0
    (earlier ones are smaller), so comparisons end at the first separator. Prefix doubling
    that sorts again only what is still tied.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    separators = symbols == 0
    m = int(separators.sum())
    rank = symbols.astype(np.int64) + m
    rank[separators] = np.arange(m)
    order = np.argsort(rank, kind="stable")
    width = 1
    tied = np.arange(n)
    while True:
        keys = rank[order[tied]] if width == 1 else keys_sorted
        change = np.empty(len(tied), bool)
        change[:1] = True
        change[1:] = keys[1:] != keys[:-1]
        if width > 1:
            change[1:] |= seconds_sorted[1:] != seconds_sorted[:-1]
        starts = np.flatnonzero(change)
        group = np.cumsum(change) - 1
        rank[order[tied]] = tied[starts][group]
        sizes = np.diff(np.append(starts, len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        if not len(tied):
            return order
        suffixes = order[tied]
        ahead = suffixes + width
        seconds = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        firsts = rank[suffixes]
        again = np.lexsort((seconds, firsts))
        order[tied] = suffixes[again]
        keys_sorted, seconds_sorted = firsts[again], seconds[again]
        width *= 2


class _Bits:
    """A bit vector with constant-time rank: one count per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels: list[tuple[_Bits, int]] = []
        self.depth = max(1, int(n_symbols - 1).bit_length())
        now = values
        for level in range(self.depth - 1, -1, -1):
            bits = ((now >> level) & 1).astype(np.uint8)
            zeros = len(bits) - int(bits.sum())
            self.levels.append((_Bits(bits), zeros))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.first = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.first[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before it."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(at).astype(np.int64), bits.rank(at)
            symbol = symbol * 2 + one
            at = np.where(one == 1, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


class FMIndex:
    """Backward search and location over ``symbols`` (0 separates, never searched)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample_every: int = 16):
        if not len(symbols) or symbols[-1]:  # the suffix behind the last word needs a row of its own
            symbols = np.append(symbols, 0)
        n = len(symbols)
        order = suffix_order(symbols)
        before = np.zeros(n, np.int64)
        inner = order > 0
        before[inner] = symbols[order[inner] - 1]
        counts = np.bincount(symbols, minlength=n_symbols)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.tree = WaveletMatrix(before, n_symbols)
        # the first word of a run is sampled as well, so that no walk crosses a separator
        sampled = (order % sample_every == 0) | (before == 0)
        self.sampled = _Bits(sampled.astype(np.uint8))
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of phrase, low, high) of the phrases (rows of equal length) that occur."""
        live = np.arange(len(phrases))
        if not len(live):
            return live, live, live
        last = phrases[:, -1]
        low, high = self.start[last], self.start[last + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            keep = high > low
            live, low, high = live[keep], low[keep], high[keep]
            if not len(live):
                break
            symbol = phrases[live, k]
            at = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.start[symbol] + at[: len(live)], self.start[symbol] + at[len(live) :]
        keep = high > low
        return live[keep], low[keep], high[keep]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row of the suffix order."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled.get(at).astype(bool)
            out[todo[hit]] = self.positions[self.sampled.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, earlier = self.tree.access_rank(at)
                at = self.start[symbol] + earlier
                steps += 1
        return out
