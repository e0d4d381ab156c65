"""FM-index over integer tokens, vectorised with numpy: one index per shard of a corpus.

The text is a row of segments, each ended by token 0. Suffixes are sorted up to the end of their
segment (ends are ordered by position); their Burrows-Wheeler transform is kept in a wavelet matrix of
bit vectors with sampled ranks. ``search`` runs the backward search of many patterns at once, and
``locate`` walks from a row to the next sampled suffix position.
"""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; only groups still equal are sorted again."""
    n = len(tokens)
    ends = tokens == 0
    n_ends = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, tokens.astype(np.int64) + n_ends - 1)
    order = np.argsort(rank, kind="stable")
    todo, step = order, 0
    at = np.arange(n)
    while len(todo):
        if step:
            far = todo + step
            second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
            key = rank[todo] * np.int64(n + n_ends + int(tokens.max()) + 2) + second
            by = np.argsort(key, kind="stable")
            key, todo = key[by], todo[by]
            order[at] = todo
        else:
            key = rank[todo]
        first = np.empty(len(todo), bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        rank[todo] = np.maximum.accumulate(np.where(first, at, 0))
        alone = first.copy()
        alone[:-1] &= first[1:]
        todo, at = todo[~alone], at[~alone]
        step = max(1, step * 2)
    return order


class Bits:
    """Bit vector with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, tokens: np.ndarray, sample: int = 16):
        """``tokens``: segments of positive tokens, each ended by 0."""
        n = len(tokens)
        order = suffix_array(tokens)
        last = np.where(order > 0, tokens[order - 1], 0)
        self.n, self.width = n, max(1, int(tokens.max()).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=1 << self.width))])
        self.levels: list[Bits] = []
        row = last
        for shift in range(self.width - 1, -1, -1):
            bit = (row >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            row = np.concatenate([row[~bit], row[bit]])
        everyone = np.arange(1 << self.width)
        self.start = self._down(everyone, np.zeros(1 << self.width, np.int64))
        # a walk ends at a sampled position; segment starts are sampled, so none leaves its segment
        here = (order % sample == 0) | (last == 0)
        self.sampled, self.places = Bits(here), order[here]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            ones = bits.rank(i)
            up = (symbol >> (self.width - 1 - level)) & 1 == 1
            i = np.where(up, self.n - bits.ones + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``i`` entries of the transform."""
        return self._down(symbol, i) - self.start[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern.

        ``patterns``: one row each, aligned to the right and filled with 0 on the left.
        """
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, -back]
            known = symbol < len(self.start)
            high[on[~known]] = low[on[~known]]
            on, symbol = on[known], symbol[known]
            low[on] = self.smaller[symbol] + self.rank(symbol, low[on])
            high[on] = self.smaller[symbol] + self.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        place = np.empty(len(rows), np.int64)
        open_, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            done = self.sampled.get(row)
            place[open_[done]] = self.places[self.sampled.rank(row[done])] + steps
            open_, row = open_[~done], row[~done]
            steps += 1
            symbol, i = np.zeros(len(row), np.int64), row
            for bits in self.levels:
                one, ones = bits.get(i), bits.rank(i)
                symbol = symbol * 2 + one
                i = np.where(one, self.n - bits.ones + ones, i - ones)
            row = self.smaller[symbol] + i - self.start[symbol]
        return place
