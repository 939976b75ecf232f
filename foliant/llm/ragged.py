"""Small numpy helpers for rows of different lengths inside Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def give_back() -> None:
    """Hands memory that Arrow and the C allocator hold but don't use back to the system: Spark keeps a Python worker
    for the next task, and beside it the JVM needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows whose sizes add up to ``most`` at the most, or one longer row."""
    a, total = 0, 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, .. of all spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each row's run of ``values``; an empty row gives 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "biu" else values.dtype)
    full = np.flatnonzero(lengths)
    if len(full):
        firsts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(values, firsts, axis=0, dtype=out.dtype)
    return out


class Memo(dict):
    """Number of each distinct word, with the ragged integers that ``make`` gives for it: for a list of words either a
    row each, or all rows in one array and their lengths. A word is worked out once; the memo is emptied between
    batches when it holds ``most`` words, so its memory is bounded."""

    def __init__(self, make: Callable, dtype, most: int = 400_000):
        super().__init__()
        self.make, self.dtype, self.most = make, dtype, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat = np.zeros(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = self.known = 0
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; new words are worked out together."""
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            try:
                self._add(self.make(self.fresh))
            except BaseException:
                self.reset()
                raise
        return out

    def _add(self, rows) -> None:
        if isinstance(rows, tuple):
            flat, sizes = rows
        else:
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter((x for row in rows for x in row), self.dtype, int(sizes.sum()))
        a, b = self.known, self.known + len(sizes)
        while b > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.lengths[a:b] = sizes
        self.starts[a:b] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used, self.known, self.fresh = self.used + len(flat), b, []

    def trim(self) -> None:
        if len(self) > self.most:
            self.reset()
