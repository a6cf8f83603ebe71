"""A compressed full-text index over integer sequences: Burrows-Wheeler transform, wavelet matrix, backward search.

Everything works on many queries at once in numpy arrays.
"""

from __future__ import annotations

import numpy as np

_U64 = np.uint64


class BitRank:
    """A bit vector with constant-time rank: packed words and the running count before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(_U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])[:-1]
        self.ones = int(np.count_nonzero(bits))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        block = i >> 6
        mask = (_U64(1) << (i & 63).astype(_U64)) - _U64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[BitRank] = []
        self.bits = max(1, int(top).bit_length())
        now = values
        for shift in range(self.bits - 1, -1, -1):
            bit = (now >> shift) & 1 == 1
            self.levels.append(BitRank(bit))
            now = np.concatenate([now[~bit], now[bit]])

        symbols = np.arange(int(top) + 1)
        self.start = np.zeros(len(symbols), np.int64)
        self.start = self._down(symbols, self.start[None, :])[0]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            ones = level.rank1(at)
            at = np.where(bit, level.n - level.ones + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` stands before lo and before hi."""
        lo, hi = self._down(symbol, np.stack([lo, hi])) - self.start[symbol]
        return lo, hi


class FMIndex:
    """Index of one sequence of symbols 1..top with 0 as separator; suffixes are ordered by their first 2^rounds symbols.

    Backward search is right for patterns of up to ``limit`` symbols, which is all that a threshold needs.
    """

    def __init__(self, text: np.ndarray, top: int, depth: int):
        n = len(text)
        self.depth, self.n = depth, n
        rank = text.astype(np.int64)
        held, half, step = rank, 1, 1
        while step < depth + 1:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + top + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            step *= 2
            if step <= depth:
                held, half = rank, step
        self.limit = step
        self.suffix = np.argsort(rank, kind="stable")
        bwt = text[self.suffix - 1]  # the symbol before each suffix, the last one for the first
        self.matrix = WaveletMatrix(bwt, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # rows whose suffixes agree on the first ``depth`` symbols: agree on the largest power of two in it from both ends
        tail = np.full(n, -1, np.int64)
        tail[: n - (depth - half)] = held[depth - half :] if depth > half else held
        a, b = self.suffix[:-1], self.suffix[1:]
        new = np.ones(n, bool)
        new[1:] = (held[a] != held[b]) | (tail[a] != tail[b])
        self.heads = np.append(np.flatnonzero(new), n)
        self.begins = BitRank(new)

    def release(self) -> np.ndarray:
        """The suffix array, which the search does without: what stays are bit vectors and counts."""
        suffix = self.suffix
        del self.suffix
        return suffix

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + P for the rows [lo, hi) of P."""
        a, b = self.matrix.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def widen(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the first ``depth`` symbols of the pattern that row ``lo`` begins with."""
        g = self.begins.rank1(lo + 1) - 1
        return self.heads[g], self.heads[g + 1]

    def statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Matching statistics, cut at ``depth``, of streamed pieces text[start:end], from their ends to their starts.

        Yields ``(which, position, lo, hi)`` for all pieces at once, one step to the left at a time, wherever the
        ``depth`` symbols from the position on occur in the index; [lo, hi) are the rows of those occurrences. Pieces
        of the indexed text are always found; others begin anew where a match breaks off.
        """
        order = np.argsort(starts - ends, kind="stable")
        at = ends[order].copy()
        floor = starts[order]
        lo = np.zeros(len(order), np.int64)
        hi = np.full(len(order), self.n, np.int64)
        length = np.zeros(len(order), np.int64)
        live = len(order)
        while live:
            while live and at[live - 1] <= floor[live - 1]:
                live -= 1
            if not live:
                break
            on = np.flatnonzero(at[:live] > floor[:live])
            at[on] -= 1
            symbol = text[at[on]]
            a, b = self.extend(symbol, lo[on], hi[on])
            length[on] += 1
            broken = a >= b
            if broken.any():
                # begin anew one symbol further to the left than the last failed start, from the piece's own window end
                bad = on[broken]
                at[bad] = at[bad] + length[bad] - 1
                lo[bad], hi[bad], length[bad] = 0, self.n, 0
                on, a, b = on[~broken], a[~broken], b[~broken]
            full = length[on] > self.depth
            if full.any():
                wide = self.widen(a[full])
                a[full], b[full] = wide
            length[on] = np.minimum(length[on], self.depth)
            lo[on], hi[on] = a, b
            hit = length[on] == self.depth
            if hit.any():
                yield order[on[hit]], at[on[hit]], a[hit], b[hit]
