"""A compressed index over a list of word sequences: Burrows-Wheeler transform in a wavelet matrix.

Used inside tasks, one index per shard. Suffixes are sorted by their first 64 words, which orders every pattern of up
to 64 words; that is all that matching up to a threshold below 64 needs.
"""

from __future__ import annotations

import numpy as np

SORTED = 64


class BitVector:
    """Bits in words of 64, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = upto >> 6
        low = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def place(self, one: np.ndarray) -> np.ndarray:
        """Where the ones of these numbers, counted from 0, lie."""
        word = np.searchsorted(self.before, one, "right") - 1
        left, bits, at = one - self.before[word], self.words[word], word << 6
        for width in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            further = left >= ones
            left, at = left - np.where(further, ones, 0), at + np.where(further, width, 0)
            bits = np.where(further, bits >> np.uint64(width), low)
        return at


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, at = [], symbols
        for shift in range(levels - 1, -1, -1):
            bits = (at >> shift) & 1
            self.levels.append((shift, BitVector(bits), int(len(bits) - bits.sum())))
            at = np.concatenate([at[bits == 0], at[bits == 1]])
        distinct = np.arange(1 << levels) if levels < 12 else np.unique(symbols)
        self.start = np.zeros(1 << levels, np.int64)
        self.start[distinct] = self._walk(distinct, np.zeros(len(distinct), np.int64))

    def _walk(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(upto)
            upto = np.where((symbol >> shift) & 1, zeros + ones, upto - ones)
        return upto

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, upto) - self.start[symbol]


class FMIndex:
    """Of sequences of positive numbers, given one after the other; a 0 follows each inside the index.

    Besides the transform it holds two bits a row: whether the row begins a block of rows that agree in their first
    `threshold` symbols, and whether its sequence stands for more than one.
    """

    def __init__(self, symbols: np.ndarray, at: np.ndarray, threshold: int, several: np.ndarray | None = None):
        """Sequence k is symbols[at[k]:at[k + 1]] and stands for several if several[k]; threshold: the length up to
        which matches are told apart."""
        if threshold >= SORTED // 2 + SORTED // 4:
            raise ValueError(f"threshold {threshold}")
        sizes = np.diff(at)
        text = np.zeros(len(symbols) + len(sizes), np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
        rank, half, width = self._ranks(text, threshold)
        order = np.argsort(rank, kind="stable")
        self.threshold, self.rows = threshold, len(order)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(text.max(initial=1)).bit_length()))
        shifted = self._later(half, threshold - width)
        new = np.ones(len(order) + 1, bool)  # the last one ends the last block
        new[1:-1] = (half[order[1:]] != half[order[:-1]]) | (shifted[order[1:]] != shifted[order[:-1]])
        self.blocks = BitVector(new)
        self.several = BitVector(np.repeat(several, sizes + 1)[order] if several is not None else np.zeros(len(order), bool))

    @staticmethod
    def _later(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[: len(values) - by] = values[by:]
        return out

    def _ranks(self, text: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ranks of suffixes by their first 64 words; and by the largest power of two up to the threshold."""
        rank, width, half, half_width = text, 1, text, 1
        while width < SORTED:
            key = rank * (len(text) + 1) + self._later(rank, width)
            _, rank = np.unique(key, return_inverse=True)
            rank, width = rank.reshape(-1) + 1, 2 * width
            if width <= threshold:
                half, half_width = rank, width
        return rank, half, half_width

    def repeated_windows(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each position of the sequences: whether `threshold` symbols from there on occur more than once.

        All sequences are read from their ends at once. A step narrows each interval by the symbol before; when a match
        is longer than the threshold, its last symbol is dropped by widening the interval to its block. Matching
        statistics, cut off at the threshold. An interval of two rows, or with a row that stands for several, repeats.
        """
        found = np.zeros(len(symbols), bool)
        order = np.argsort(-np.diff(at), kind="stable")
        begin, end = at[:-1][order], at[1:][order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.rows, np.int64)
        length = np.zeros(len(order), np.int64)
        for step in range(1, int((end - begin).max(initial=0)) + 1):
            live = int(np.searchsorted(begin - end, -step, "right"))
            position = end[:live] - step
            symbol = symbols[position]
            l, h, size = low[:live], high[:live], length[:live]
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([l, h]))
            l, h = self.first[symbol] + both[:live], self.first[symbol] + both[live:]
            size = np.where(h > l, size + 1, 0)
            long = np.flatnonzero(size > self.threshold)
            l[long] = self.blocks.place(self.blocks.ones(l[long] + 1) - 1)
            h[long] = self.blocks.place(self.blocks.ones(h[long]))
            size[long] = self.threshold
            full = np.flatnonzero(size == self.threshold)
            a, z = l[full], h[full]
            found[position[full]] = (z - a >= 2) | (self.several.ones(z) > self.several.ones(a))
            low[:live], high[:live], length[:live] = np.where(size > 0, l, 0), np.where(size > 0, h, self.rows), size
        return found
