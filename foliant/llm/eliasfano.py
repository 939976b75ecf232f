"""Elias-Fano sequences and a two-level n-gram trie over them, in one flat buffer that can be memory-mapped."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U = np.uint64


def select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit; ``before`` counts the set bits ahead of each 64-bit word."""
    at = np.searchsorted(before, k, "right") - 1
    x, r = words[at], (k - before[at]).astype(np.int64)
    pos = np.zeros(len(k), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(x & U((1 << width) - 1)).astype(np.int64)
        go = r >= ones
        r -= np.where(go, ones, 0)
        x = np.where(go, x >> U(width), x)
        pos += np.where(go, width, 0)
    return at * 64 + pos


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first value of each run of equal ones, and each value's run."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new], np.cumsum(new) - 1


class EliasFano:
    """A non-decreasing sequence of n integers: low bits as they are, high bits in unary."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs = n, low_bits, lows, highs
        ones = np.bitwise_count(highs).astype(np.int64)
        self.ones_before = np.cumsum(ones) - ones
        self.zeros_before = np.arange(len(highs), dtype=np.int64) * 64 - self.ones_before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        low = min((low + 7) // 8 * 8, 56)  # whole bytes keep the low bits addressable
        raw = values.astype("<u8").view(np.uint8).reshape(n, 8)
        high = (values.astype(U) >> U(low)).astype(np.int64)
        bits = np.zeros(-(-(n + (top >> low) + 2) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        return cls(n, low, np.ascontiguousarray(raw[:, : low // 8]).ravel(), np.packbits(bits, bitorder="little").view("<u8"))

    def get(self, index: np.ndarray) -> np.ndarray:
        high = select(self.highs, self.ones_before, index) - index
        return (high.astype(U) << U(self.low_bits)) | self._low(index)

    def _low(self, index: np.ndarray) -> np.ndarray:
        out, m = np.zeros(len(index), U), self.low_bits // 8
        for k in range(m):
            out |= self.lows[index * m + k].astype(U) << U(8 * k)
        return out

    def successor(self, targets: np.ndarray) -> np.ndarray:
        """Index of the first value that isn't below each target; n if there is none."""
        return self._search(targets)[0]

    def _search(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successors, and whether each is the target. The high bits give the values to look at, once for targets beside
        each other that share them; they hold a value or two, and more are halved."""
        wanted, where = runs(targets >> U(self.low_bits))
        high = np.minimum(wanted, U(max(0, 64 * len(self.highs) - self.n - 2))).astype(np.int64)
        inverse = ~self.highs
        begin = np.zeros(len(high), np.int64)
        some = high > 0
        begin[some] = select(inverse, self.zeros_before, high[some] - 1) + 1 - high[some]
        stop = np.where(high.astype(U) == wanted, select(inverse, self.zeros_before, high) - high, -1)
        begin = np.where(stop < 0, self.n, begin)  # above all values
        first, end = begin[where], stop[where]
        low = targets & U((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(first < end)
        while len(open_):
            mid = (first[open_] + end[open_]) // 2
            less = self._low(mid) < low[open_]
            first[open_] = np.where(less, mid + 1, first[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[first[open_] < end[open_]]
        found = np.flatnonzero(first < stop[where])
        hit = np.zeros(len(targets), bool)
        hit[found] = self._low(first[found]) == low[found]
        return first, hit

    def find(self, targets: np.ndarray) -> np.ndarray:
        """Index of each target, -1 where the sequence lacks it."""
        if not self.n:
            return np.full(len(targets), -1)
        at, hit = self._search(targets)
        return np.where(hit, at, -1)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.lows), len(self.highs)], "<u8"), self.lows, self.highs]


class Trie:
    """Contexts, pointers to their successors, successors, and a quantised probability for each successor. All
    sequences are monotone: a successor is stored as its id above the last value of the context before it."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def of(cls, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray) -> Trie:
        """From distinct (context, word) pairs in order, words being ids under 2**32."""
        keys, firsts = np.unique(contexts, return_index=True)
        ends = np.append(firsts[1:], len(words))
        tops = words[ends - 1].astype(U) + U(1) if len(words) else np.zeros(0, U)
        base = np.cumsum(tops) - tops
        values = words.astype(U) + np.repeat(base, ends - firsts)
        return cls(EliasFano.of(keys), EliasFano.of(np.append(firsts, len(words)).astype(U)), EliasFano.of(values), codes.astype(np.uint8))

    def codes_of(self, contexts: np.ndarray, words: np.ndarray, missing: int) -> np.ndarray:
        """Code of each pair, ``missing`` where the trie lacks it."""
        out = np.full(len(contexts), missing, np.uint8)
        if not self.contexts.n:
            return out
        keys, where = runs(contexts)
        rank = self.contexts.find(keys)
        known = np.flatnonzero(rank >= 0)
        first = np.zeros(len(keys), np.int64)
        last = np.zeros(len(keys), np.int64)
        first[known] = self.pointers.get(rank[known]).astype(np.int64)
        last[known] = self.pointers.get(rank[known] + 1).astype(np.int64) - 1
        base, top = np.zeros(len(keys), U), np.zeros(len(keys), U)
        inner = known[first[known] > 0]
        base[inner] = self.successors.get(first[inner] - 1) + U(1)
        top[known] = self.successors.get(last[known])
        target = words.astype(U) + base[where]
        ask = np.flatnonzero((rank[where] >= 0) & (target <= top[where]))
        found = self.successors.find(target[ask])
        hit = found >= 0
        out[ask[hit]] = self.codes[found[hit]]
        return out

    def mapped(self) -> Trie:
        """The same trie over a memory-mapped file, which has no name and goes with its last user."""
        parts = [*self.contexts.parts(), *self.pointers.parts(), *self.successors.parts(), np.array([len(self.codes)], "<u8"), self.codes]
        with tempfile.TemporaryFile() as file:
            for p in parts:
                file.write(p.tobytes())
                file.write(b"\0" * (-p.nbytes % 8))
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at = 0

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        def sequence() -> EliasFano:
            n, low, a, b = take(4, "<u8").tolist()
            return EliasFano(n, low, take(a, np.uint8), take(b, "<u8"))

        return Trie(sequence(), sequence(), sequence(), take(int(take(1, "<u8")[0]), np.uint8))
