"""Words, word hashes and shingles of Arrow string columns, in numpy.

A word is a run of characters other than space and U+0009 to U+000D.  Texts
are never turned into Python strings: the UTF-8 buffer of the Arrow column is
scanned in blocks, so memory is a small multiple of one block plus eight bytes
or so for each word.

The hash of a word is a polynomial over a table of random 64-bit values,
taken modulo 2**64 by prefix sums, and mixed.  It depends on nothing but the
word's bytes, so that all executors and all runs agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
BLOCK = 1 << 17
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True



def give_back(arrow: bool = False) -> None:
    """Hand memory that has been freed back to the system, with ``arrow`` that of Arrow's pool too; a worker's peak is then that of one batch."""
    if arrow:
        pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(0, 2**64, 256, dtype=U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche (two multiply-shift rounds)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's first and last offset in them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]


def blocks(first: np.ndarray, last: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most ``most`` bytes together; a longer row is a run of its own."""
    i = 0
    while i < len(first):
        j = int(np.searchsorted(last, first[i] + most, "right"))
        yield i, (j := max(j, i + 1))
        i = j


class Words:
    """The words of a run of rows.

    ``begin`` and ``end`` are byte offsets in ``data``; row r has the words
    ``of[r]`` to ``of[r + 1]``.  Hashes are made on demand.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.data = data = data[first[0] : last[-1]] if len(first) else data[:0]
        self.first = first - (base := first[0] if len(first) else 0)
        self.last = last - base
        inside = ~SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        if len(data):
            edge = self.first[self.first < self.last]
            opens[edge] = inside[edge]
            edge = self.last[self.first < self.last] - 1
            closes[edge] = inside[edge]
        self.begin = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.of = np.append(np.searchsorted(self.begin, self.first), len(self.begin))
        self.count = np.diff(self.of)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.begin, self.end)

    def rows(self) -> np.ndarray:
        """Each word's row."""
        return np.repeat(np.arange(len(self.count)), self.count)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = BLOCK) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap and are in order."""
    out = np.empty(len(begin), U64)
    i = 0
    while i < len(begin):
        j = max(int(np.searchsorted(end, begin[i] + most, "right")), i + 1)
        lo, hi = int(begin[i]), int(end[j - 1])
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        b, e = begin[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(U64) * U64(0xA24BAED4963EE407))
        i = j
    return out


def window_hashes(word: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's windows of ``width`` words, and where each row's begin (one more at the end).

    A row with fewer words, but one at least, has one window of all its words.
    """
    n = np.diff(of)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    if not len(word):
        return np.empty(0, U64), at
    padded = np.concatenate([word, np.zeros(width, U64)])
    full = np.zeros(len(word), U64)
    for k in range(width):
        full += padded[k : k + len(word)] * _PLACE[k]
    shift = np.repeat(of[:-1] - at[:-1], many)
    out = full[np.arange(at[-1]) + shift]
    for r in np.flatnonzero((n > 0) & (n < width)):
        own = np.append(word[of[r] : of[r + 1]], U64(n[r]))
        out[at[r]] = np.add.reduce(own * np.append(_PLACE[: n[r]], _PLACE[width]))
    return mix(out), at


class Index:
    """Numbers for 64-bit keys in order of arrival: an open-addressing table whose probes run over whole arrays."""

    def __init__(self, bits: int = 21):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.n = 0

    def full(self, more: int) -> bool:
        return 2 * (self.n + more) > self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot = (keys & U64(self.mask)).astype(np.int64)
        out = self.values[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            out[left] = got = self.values[slot]
            again = (self.keys[slot] != keys[left]) & (got >= 0)
            left, slot = left[again], slot[again]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for distinct keys that are not in the table yet."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        left, slot = np.arange(len(keys)), (keys & U64(self.mask)).astype(np.int64)
        while len(left):
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= self.values[slot] < 0
            self.keys[slot[won]] = keys[left[won]]
            self.values[slot[won]] = numbers[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask
        return numbers


class Remembered:
    """What is known of distinct words, found by hash; ``learn`` is asked once for each word while it is remembered.

    Memory is bounded: when the table is half full, words that were not met
    again since it last was are forgotten, and all are if that is not enough.
    """

    def __init__(self, learn, bits: int = 21):
        self.learn, self.bits = learn, bits
        self._empty()

    def _empty(self) -> None:
        self.index = Index(self.bits)
        self.store = self.learn([])
        self.again = np.zeros(0, bool)

    def _sweep(self) -> None:
        """Forget the words that were not met again."""
        known = np.flatnonzero(self.index.values >= 0)
        keys = np.empty(self.index.n, U64)
        keys[self.index.values[known]] = self.index.keys[known]
        which = np.flatnonzero(self.again)
        self.index, self.store = Index(self.bits), self.store.kept(which)
        self.index.add(keys[which])
        self.again = np.zeros(len(which), bool)

    def _unknown(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each hash's number, or -1; the hashes without one, and where each is first."""
        at = self.index.find(h)
        missing = np.flatnonzero(at < 0)
        new, first = np.unique(h[missing], return_index=True)
        return at, new, missing[first]

    def numbers(self, words: Words) -> np.ndarray:
        """A number for each word; row ``number`` of the store has what is known of it."""
        h = words.hashes()
        at, new, spans = self._unknown(h)
        self.again[at[at >= 0]] = True
        for room in (self._sweep, self._empty):
            if self.index.full(len(new)) and self.index.n:
                room()
                at, new, spans = self._unknown(h)
        if len(new):
            while self.index.full(len(new)):
                self.bits += 1
                self.index = Index(self.bits)
            raw = words.data.tobytes()
            self.store = self.store + self.learn([raw[b:e] for b, e in zip(words.begin[spans].tolist(), words.end[spans].tolist(), strict=True)])
            self.index.add(new)
            self.again = np.append(self.again, np.zeros(len(new), bool))
            at = self.index.find(h)
        return at
