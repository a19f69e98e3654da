"""An FM-index over word symbols: backward search by wavelet-matrix ranks, located by sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Text positions between two sampled suffixes.
SAMPLE = 8
#: Occurrences that are located at once.
LOCATE = 1 << 19


class Bits:
    """A bit vector with constant-time rank: a running count for each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.bitwise_count(self.words).astype(np.int64).cumsum()])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix over symbols 0..top: rank of any symbol in one step for each bit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, s = [], symbols
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (s >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), len(s) - int(bit.sum())))
            s = np.concatenate([s[~bit], s[bit]])
        every = np.arange(top + 1)
        self.first = self._walk(every, np.zeros(top + 1, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbols c before positions i."""
        return self._walk(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and their ranks there."""
        c = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.first[c]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of symbols that end in 0; each 0 counts as a symbol of its own, in text order.

    Prefix doubling; only suffixes that still tie are sorted again.
    """
    n = len(symbols)
    stops = symbols == 0
    key = np.where(stops, stops.cumsum(), symbols.astype(np.int64) + n + 1)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_):
            return sa
        i = sa[open_]
        both = rank[i] * n + rank[i + step]  # a suffix that ties has no 0 in its first `step` symbols
        order = np.argsort(both, kind="stable")
        i, both = i[order], both[order]
        sa[open_] = i
        new = np.ones(len(i), bool)
        new[1:] = both[1:] != both[:-1]
        head[open_] = new
        rank[i] = open_[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
        step *= 2


class FMIndex:
    """Symbols 1..top in runs that each end in 0; patterns never match across a 0."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n = len(symbols)
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1].astype(np.int64)  # of the suffix at 0 it is the last symbol, a 0
        self.wavelet = Wavelet(bwt, top)
        counts = np.bincount(symbols, minlength=top + 1)
        self.before = np.concatenate([[0], counts.cumsum()[:-1]])
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.sampled, self.positions = Bits(sampled), sa[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of patterns (rows of symbols, filled on the right), all searched together."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            now = live[lengths[live] > k]
            c = patterns[now, k].astype(np.int64)
            low[now] = self.before[c] + self.wavelet.rank(c, low[now])
            high[now] = self.before[c] + self.wavelet.rank(c, high[now])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray):
        """Yield (pattern index, text position) arrays for all rows of the ranges, in bounded parts."""
        which = np.flatnonzero(high > low)
        start = 0
        sizes = (high - low)[which]
        ends = sizes.cumsum()
        while start < len(which):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + LOCATE, "right")))
            w, s = which[start:stop], sizes[start:stop]
            offset = np.arange(s.sum()) - np.repeat(s.cumsum() - s, s)
            yield np.repeat(w, s), self._positions(np.repeat(low[w], s) + offset)
            start = stop

    def _positions(self, rows: np.ndarray) -> np.ndarray:
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            hit = self.sampled.get(rows)
            out[live[hit]] = self.positions[self.sampled.rank(rows[hit])] + steps
            live, rows = live[~hit], rows[~hit]
            c, rank = self.wavelet.access(rows)
            rows, steps = self.before[c] + rank, steps + 1
        return out
