"""Runs of bytes of a class in Arrow string columns, and counts of distinct runs, in numpy.

Texts are never turned into Python strings: the UTF-8 buffer of the column is
scanned in blocks.  Both classes below are told by bytes alone, as 0xC3 leads
the code points U+00C0 to U+00FF and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm import words as W

#: A task holds half of 2**this many distinct runs at most before it hands their counts on.
INDEX_BITS = 19
#: Bytes of text that are cut into runs at once.
BLOCK = 1 << 20

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
NOT_ASCII = np.arange(256) >= 0x80
#: Of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def terms(data: np.ndarray) -> np.ndarray:
    """Whether each byte is part of a run of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``."""
    return (LETTERS | NOT_ASCII)[data]


def latin(data: np.ndarray) -> np.ndarray:
    """Whether each byte is part of a run of ``[A-Za-z\\u00C0-\\u00FF]``."""
    lead = data == 0xC3
    inside = LETTERS[data] | lead
    inside[1:] |= lead[:-1]
    return inside


class Runs(W.Words):
    """Maximal runs of the bytes of a class in a run of rows, with A-Z lower-cased; otherwise as ``Words``."""

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, kind):
        data = data[first[0] : last[-1]] if len(first) else data[:0]
        self.data = LOWER[data]
        self.first = first - (base := first[0] if len(first) else 0)
        self.last = last - base
        # a byte between two rows is none of theirs: runs end where rows do
        inside = kind(data)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        if len(data):
            full = self.first < self.last
            opens[self.first[full]] = inside[self.first[full]]
            closes[self.last[full] - 1] = inside[self.last[full] - 1]
        self.begin = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.of = np.append(np.searchsorted(self.begin, self.first), len(self.begin))
        self.count = np.diff(self.of)


def blocks(column: pa.Array, kind) -> Iterator[tuple[int, Runs]]:
    """The runs of a column's rows, some rows at a time, with the number of the first of these rows."""
    data, first, last = W.buffers(column)
    for i, j in W.blocks(first, last, BLOCK):
        yield i, Runs(data, first[i:j], last[i:j], kind)


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow column, copied without Python objects."""
    n = end - begin
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    flat = data[np.arange(total) + np.repeat(begin - (ends - n), n)]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))


class Counter:
    """Sums for distinct (group, run), told by 64-bit hashes while they are held; memory is bounded.

    ``add`` gives what it had to let go of: (groups, runs, sums by column).
    """

    def __init__(self, columns: int = 1, bits: int = INDEX_BITS):
        self.columns, self.bits = columns, bits
        self._empty()

    def _empty(self) -> None:
        self.index = W.Index(self.bits)
        self.runs: list[pa.Array] = []
        self.groups: list[np.ndarray] = []
        self.sums = np.zeros((self.columns, 1 << 10), np.int64)

    def add(self, runs: Runs, which: np.ndarray, hashes: np.ndarray, groups: np.ndarray, counts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """Count the runs ``which`` of one block; ``hashes`` tell (group, run) apart, ``counts`` has a row for each column of sums."""
        at = self.index.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            _, first = np.unique(hashes[missing], return_index=True)
            if self.index.full(len(first)) and self.index.n:
                yield from self.rest()
                yield from self.add(runs, which, hashes, groups, counts)
                return
            while self.index.full(len(first)):
                self.bits += 1
                self.index = W.Index(self.bits)
            new = missing[first]
            self.runs.append(strings(runs.data, runs.begin[which[new]], runs.end[which[new]]))
            self.groups.append(groups[new])
            self.index.add(hashes[new])
            at = self.index.find(hashes)
        n = self.index.n
        if n > self.sums.shape[1]:
            self.sums = np.pad(self.sums, ((0, 0), (0, max(n, 2 * self.sums.shape[1]) - self.sums.shape[1])))
        for k, own in enumerate(counts):
            self.sums[k, :n] += np.bincount(at, own, minlength=n).astype(np.int64)

    def rest(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """All that is held; nothing is held after it."""
        if self.index.n:
            yield np.concatenate(self.groups), pa.concat_arrays(self.runs), self.sums[:, : self.index.n]
        self._empty()
