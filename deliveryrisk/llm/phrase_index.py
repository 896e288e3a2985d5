"""An FM-index of a sequence of numbers (word ids): find and locate short phrases.

The sequence holds texts one after another, each ended by the number 0. Its
suffixes are sorted completely (an end sorts before every word, ends among each
other by place), so rows of the index are suffixes. The last column, the number
before each suffix, is kept as a wavelet tree laid out level by level: a level
holds one bit of every number, stably sorted by the bits before. Backward search
narrows a range of rows by one phrase number at a time with two ranks. A row is
located by stepping to the row of the suffix one place earlier until a sampled
row is met; every ``SAMPLE``-th place and every first place of a text is sampled.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np

SAMPLE = 16
WORD = 64


def suffix_order(numbers: np.ndarray) -> np.ndarray:
    """Places of all suffixes in sorted order.

    First by as many numbers as fit in one key, then by doubling the length;
    only groups of suffixes that are still equal are sorted again.
    """
    n = len(numbers)
    ends = numbers == 0
    n_ends = int(ends.sum())
    # ends differ from each other, so no suffix is compared beyond its text
    symbol = np.where(ends, np.cumsum(ends) - 1, numbers.astype(np.int64) + n_ends)
    bits = max(1, int(symbol.max(initial=1)).bit_length())
    length = min(n, max(1, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    done = np.zeros(n, dtype=bool)
    for i in range(length):
        # what follows an end is the same for nobody, so it need not be looked at
        step = np.zeros(n, dtype=np.int64)
        step[: n - i] = np.where(done[: n - i], 0, symbol[i:])
        key = (key << bits) | step
        done[: n - i] |= ends[i:]
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n, dtype=np.int64)
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    ranks[order] = first
    open_ = np.flatnonzero(same | np.concatenate((same[1:], [False])))
    while open_.size:
        at = order[open_]
        second = ranks[at + length]
        again = np.lexsort((second, ranks[at]))
        at, second = at[again], second[again]
        order[open_] = at
        group = ranks[at]
        same = np.concatenate(([False], (group[1:] == group[:-1]) & (second[1:] == second[:-1])))
        ranks[at] = open_[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
        open_ = open_[same | np.concatenate((same[1:], [False]))]
        length *= 2
    return order


class Bits:
    """A bit vector with rank."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @staticmethod
    def pack(flags: np.ndarray) -> np.ndarray:
        """Flags as 64-bit words, lowest bit first, with at least one spare bit."""
        size = len(flags) // WORD + 1
        padded = np.zeros(size * WORD, dtype=np.uint8)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of numbers in a sequence, by one bit vector a level."""

    def __init__(self, levels: list[np.ndarray], zeros: np.ndarray) -> None:
        self.levels = [Bits(words) for words in levels]
        self.zeros = zeros

    @staticmethod
    def build(sequence: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        levels, zeros = [], []
        for b in range(bits - 1, -1, -1):
            flags = ((sequence >> b) & 1).astype(bool)
            levels.append(Bits.pack(flags))
            zeros.append(len(flags) - int(flags.sum()))
            sequence = np.concatenate((sequence[~flags], sequence[flags]))
        return levels, np.array(zeros, dtype=np.int64)

    def down(self, number: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place below the last level where occurrences of each number among the first i end."""
        top = len(self.levels) - 1
        for level, bits in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where((number >> (top - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, number: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each number occurs among the first i."""
        return self.down(number, i) - self.down(number, np.zeros_like(i))

    def read(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        number = np.zeros(len(i), dtype=np.int64)
        for level, bits in enumerate(self.levels):
            on, ones = bits.get(i), bits.rank(i)
            number = (number << 1) | on
            i = np.where(on, self.zeros[level] + ones, i - ones)
        return number


class Index(NamedTuple):
    """An index that can be searched."""

    starts: np.ndarray
    tree: WaveletTree
    sampled: Bits
    places: np.ndarray

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from, to) of suffixes beginning with each phrase; phrases of one length, a row each."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.starts[-1])
        live = np.arange(len(phrases))
        for number in phrases.T[::-1]:
            # a phrase that occurs nowhere needs no further step
            live = live[low[live] < high[live]]
            c = number[live]
            low[live] = self.starts[c] + self.tree.rank(c, low[live])
            high[live] = self.starts[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes of rows."""
        found = np.empty(len(rows), dtype=np.int64)
        at, row, steps = np.arange(len(rows)), rows, 0
        while at.size:
            hit = self.sampled.get(row)
            found[at[hit]] = self.places[self.sampled.rank(row[hit])] + steps
            at, row = at[~hit], row[~hit]
            c = self.tree.read(row)
            row = self.starts[c] + self.tree.rank(c, row)
            steps += 1
        return found


def build(numbers: np.ndarray, highest: int) -> bytes:
    """Index of texts that are each ended by 0, as bytes; ``highest`` is the largest number that may occur."""
    order = suffix_order(numbers)
    last = numbers[order - 1]  # before the first place comes the last one, an end
    levels, zeros = WaveletTree.build(last, max(1, int(highest).bit_length()))
    starts = np.concatenate(([0], np.cumsum(np.bincount(numbers, minlength=highest + 1))))
    first = np.concatenate(([True], numbers[:-1] == 0))
    kept = first[order] | (order % SAMPLE == 0)
    out = io.BytesIO()
    np.savez(
        out, starts=starts.astype(np.int32), levels=np.array(levels), zeros=zeros,
        sampled=Bits.pack(kept), places=order[kept].astype(np.int32),
    )
    return out.getvalue()


def load(data: bytes) -> Index:
    with np.load(io.BytesIO(data)) as f:
        return Index(
            f["starts"].astype(np.int64), WaveletTree(list(f["levels"]), f["zeros"]), Bits(f["sampled"]), f["places"].astype(np.int64)
        )
