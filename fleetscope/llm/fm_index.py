"""An FM-index over words: suffix order, wavelet matrix of the transform, sampled positions."""

from __future__ import annotations

import numpy as np

# A suffix position is kept for every so many words; others are found by stepping back.
SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of ``symbols`` (positive integers) by doubling, going on only with suffixes still tied."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length() if n else 1
    pack = max(1, min(3, 62 // bits))
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(pack, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(pack):
        key = (key << bits) | padded[k:k + n]
    order = np.argsort(key)
    rank = np.zeros(n + 1, np.int64)
    slots = np.arange(n)
    tied, h = order, pack
    sorted_key = key[order]
    while True:
        # Rank of a suffix: the slot where its group begins, plus one; nothing is zero.
        head = np.ones(len(slots), bool)
        head[1:] = sorted_key[1:] != sorted_key[:-1]
        start = np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))
        order[slots] = tied
        rank[tied] = slots[start] + 1
        alone = head & np.append(head[1:], True)
        slots, tied = slots[~alone], tied[~alone]
        if not len(slots):
            return order
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + h, n)]
        by = np.argsort(key)
        tied, sorted_key = tied[by], key[by]
        h *= 2


class FmIndex:
    """Words of some documents, searchable backwards.

    ``symbols`` holds word codes above the document ends, which are all different, so no match
    runs over the end of a document.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = len(symbols)
        order = suffix_order(symbols)
        column = symbols[order - 1]
        self.levels = max(1, int(symbols.max()).bit_length()) if self.n else 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=(1 << self.levels)))])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((column >> level) & 1).astype(bool)
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            column = np.concatenate([column[~bit], column[bit]])
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = order[sampled]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before ``row`` whose preceding symbol is ``symbol``, as a row of that symbol's block."""
        base, at = np.zeros(len(row), np.int64), row.astype(np.int64)
        for level in range(self.levels):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = ones[at], ones[base]
            at = np.where(up, zeros + a, at - a)
            base = np.where(up, zeros + b, base - b)
        return self.before[symbol] + at - base

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of symbols) that occur, and the rows [lo, hi) of each."""
        found = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[found, k]
            lo, hi = self.step(symbol, lo), self.step(symbol, hi)
            some = hi > lo
            found, lo, hi = found[some], lo[some], hi[some]
        return found, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled one."""
        out, at, steps = np.zeros(len(row), np.int64), row.astype(np.int64), 0
        open_ = np.arange(len(row))
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.samples[self.sample_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            at = self._back(at)
            steps += 1
        return out

    def _back(self, row: np.ndarray) -> np.ndarray:
        symbol, at, base = np.zeros(len(row), np.int64), row, np.zeros(len(row), np.int64)
        for level in range(self.levels):
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[at], ones[base]
            up = ones[at + 1] > a
            symbol = symbol * 2 + up
            at = np.where(up, zeros + a, at - a)
            # The block begins where the same turns lead from the first row.
            base = np.where(up, zeros + b, base - b)
        return self.before[symbol] + at - base
