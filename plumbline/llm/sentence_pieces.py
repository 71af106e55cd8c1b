"""Encoding and decoding by a SentencePiece BPE file, with each piece's span in the original bytes.

The file gives pieces with scores and a normaliser: a compiled character map
(a double-array trie over UTF-8 and the strings that its entries are replaced
by) and rules for white space.  All of it is read from the file; the library
is not needed.

Normalisation walks the trie from every character of a block of texts at once
and takes the longest entry; of entries that overlap the earlier one holds.
Each byte that comes out keeps the offset of the input that it stands for, so
that a piece's end in the normalised text is projected to one in the original.

Two characters that no piece holds side by side can never be merged, so texts
are cut there; each distinct chunk is merged once for as long as a worker
remembers it.  Within a chunk the pair of the highest score is merged, the
leftmost first, as long as there is one; characters without a piece fall back
to bytes, of which the last has the character's span.

Spaces are written U+2581 in the file; here they stand as one byte 0x20 in
normalised texts, and so does a U+2581 of the text itself, which the file
cannot tell from a space.

Defined cases: a null text is the empty one, which has no pieces; texts of any
length are encoded whole; bytes that are no UTF-8 count as U+FFFD, one for
each; repeated rows are encoded one by one; a table without rows gives none;
only doc_id and the text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import words as W
from plumbline.llm.token_output import Ids, slices
from plumbline.llm.vocabulary import vocabulary_path

FILE = "piece_bpe_32k.model"
#: A Python worker remembers half of 2**this many distinct chunks at most.
INDEX_BITS = 20
#: Characters from which a chunk's pairs are kept in a heap.
LONG = 48
SPACE = "▁"
# fixed values: kinds of pieces in the file
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = blob[i]
            i += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    while i < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, blob[i : i + n]
            i += n
        elif kind == 2:
            n = varint()
            yield tag >> 3, blob[i : i + n]
            i += n
        else:
            raise ValueError("not a file of pieces")


@dataclass(frozen=True)
class Spec:
    """What an encoder needs to know of a file."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    byte_fallback: bool
    unknown: str
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool

    @classmethod
    def parse(cls, blob: bytes) -> "Spec":
        pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in fields(blob):
            if number == 1:
                own = dict(fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(np.frombuffer(own[2], "<f4")[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE files are supported")
        if trainer.get(24, 0) or not normalizer.get(5, 1) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("the file uses options that are not supported here")
        return cls(
            pieces, np.array(scores, np.float64), np.array(kinds), bool(trainer.get(35, 0)), trainer.get(44, b" \xe2\x81\x87 ").decode(), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        )


class CharacterMap:
    """The compiled map of a file: longest entries of a trie and what they are replaced by."""

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob[:4], "<u4")[0])
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.strings = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.strings == 0)
        self.ends = ends
        double = np.flatnonzero((self.strings[1:] == 0x20) & (self.strings[:-1] == 0x20))
        if len(double):
            raise ValueError("the character map yields double spaces")

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest entry that begins at each place (0: none) and where its string begins."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, node = np.arange(len(at)), np.full(len(at), self._offset(self.units[:1])[0])
        step = 0
        while True:
            ok = at[live] + step < end[live]
            live, node = live[ok], node[ok]
            if not len(live):
                return length, value
            byte = data[at[live] + step].astype(np.int64)
            node = node ^ byte
            ok = node < len(self.units)
            unit = self.units[np.where(ok, node, 0)]
            ok &= (unit & 0x800000FF) == byte
            live, node, unit = live[ok], node[ok], unit[ok]
            node = node ^ self._offset(unit)
            leaf = (unit >> 8) & 1 == 1
            step += 1
            length[live[leaf]] = step
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF

    def sizes(self, value: np.ndarray) -> np.ndarray:
        """Bytes of the strings that begin at ``value``."""
        return self.ends[np.searchsorted(self.ends, value)] - value


def gather(source: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The spans of ``source`` one after the other."""
    ends = np.cumsum(n)
    return source[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - n), n)]


class Normalised:
    """Texts of a run of rows as the file normalises them: ``data``, rows ``first`` to ``last``.

    ``origin`` has the offset of the row's input that each byte stands for;
    ``end_origin`` has that of each row's end.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, origin: np.ndarray, end_origin: np.ndarray):
        self.data, self.first, self.last, self.origin, self.end_origin = data, first, last, origin, end_origin


def _rows_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first)), last - first)


class Normaliser:
    def __init__(self, spec: Spec):
        self.map = CharacterMap(spec.charsmap) if spec.charsmap else None
        self.dummy_prefix, self.remove_extra = spec.dummy_prefix, spec.remove_extra

    def _mapped(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the character map, the input offset in ``data`` of each, and each one's row."""
        row = _rows_of(first, last)
        place = np.arange(len(data))
        if self.map is None:
            return data, place, row
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        length, value = self.map.longest(data, starts, last[row[starts]])
        char = np.diff(np.append(starts, len(data)))
        # an entry of several characters takes away those behind its first, and what begins there
        gone = np.zeros(len(starts), bool)
        until = -1
        for k in np.flatnonzero(length > char).tolist():
            if starts[k] >= until:
                until = int(starts[k] + length[k])
                gone[k + 1 : np.searchsorted(starts, until)] = True
        starts, length, value, char = starts[~gone], length[~gone], value[~gone], char[~gone]
        hit = length > 0
        n = np.where(hit, 0, char)
        n[hit] = self.map.sizes(value[hit])
        source = np.concatenate([data, self.map.strings])
        out = gather(source, np.where(hit, len(data) + value, starts), n)
        place = np.repeat(starts, n)
        return out, place, row[place]

    def run(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> Normalised:
        """Normalise rows that lie in ``data`` one after the other, from its first byte to its last."""
        n_rows = len(first)
        out, place, row = self._mapped(data, first, last)
        end_origin = (last - first).astype(np.int64)
        if self.remove_extra and len(out):
            blank = out == 0x20
            before = np.ones(len(out), bool)
            before[1:] = blank[:-1] | (row[1:] != row[:-1])
            keep = ~(blank & before)
            out, place, row = out[keep], place[keep], row[keep]
        origin = place - first[row]
        # a U+2581 of the text is a space from here on
        mark = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if len(out) > 2 else []
        if len(mark):
            keep = np.ones(len(out), bool)
            keep[mark + 1] = keep[mark + 2] = False
            out = out.copy()
            out[mark] = 0x20
            out, origin, row = out[keep], origin[keep], row[keep]
        if self.remove_extra and len(out):
            # spaces at a row's end, and all of the input behind their beginning, are not part of the text
            visible = np.where(out != 0x20, np.arange(len(out)), -1)
            head = np.append(True, row[1:] != row[:-1])
            last_visible = np.maximum.reduceat(visible, np.flatnonzero(head))[np.cumsum(head) - 1]
            keep = np.arange(len(out)) <= last_visible
            tail = np.flatnonzero(~keep)[::-1]
            end_origin[row[tail]] = origin[tail]  # of a row's spaces the first is written last
            out, origin, row = out[keep], origin[keep], row[keep]
        size = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
        begin = np.cumsum(size) - size
        if self.dummy_prefix:
            full = np.flatnonzero(size > 0)
            # without extra spaces the prefix stands where the first character that is left begins
            own = origin[begin[full]] if self.remove_extra else np.zeros(len(full), np.int64)
            out, origin = np.insert(out, begin[full], 0x20), np.insert(origin, begin[full], own)
            size = size + (size > 0)
            begin = np.cumsum(size) - size
        return Normalised(out, begin, begin + size, origin, end_origin)


class Pieces:
    """Ragged ids of a list of chunks, and the normalised bytes that each id stands for."""

    def __init__(self, ids: Ids, sizes: Ids):
        self.ids, self.sizes = ids, sizes

    def __add__(self, other: "Pieces") -> "Pieces":
        return Pieces(self.ids + other.ids, self.sizes + other.sizes)

    def kept(self, which: np.ndarray) -> "Pieces":
        return Pieces(self.ids.kept(which), self.sizes.kept(which))


class Encoded:
    """Ids of rows one after the other, ``n`` for each row, with begin and end in the row's original bytes."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.ids, self.n, self.begin, self.end = ids, n, begin, end


class Processor:
    """Encodes and decodes texts by one file."""

    def __init__(self, path: str, bits: int = INDEX_BITS):
        with open(path, "rb") as f:
            self._init(Spec.parse(f.read()), bits)

    @classmethod
    def of(cls, spec: Spec, bits: int = INDEX_BITS) -> "Processor":
        out = cls.__new__(cls)
        out._init(spec, bits)
        return out

    def _init(self, spec: Spec, bits: int) -> None:
        self.spec = spec
        self.normaliser = Normaliser(spec)
        own = [p.replace(SPACE, " ") for p in spec.pieces]
        normal = np.flatnonzero(spec.kinds == NORMAL).tolist()
        self.known = {own[i]: (-spec.scores[i], i) for i in normal}
        self.unknown = int(np.flatnonzero(spec.kinds == UNKNOWN)[0])
        self.bytes_ = np.zeros(256, np.int64)
        for i in np.flatnonzero(spec.kinds == BYTE).tolist():
            self.bytes_[int(spec.pieces[i][3:5], 16)] = i
        #: whether two characters may meet in a piece, told by the last byte of one and the first of the other
        self.meet = np.zeros(1 << 16, bool)
        for i in normal:
            for a, b in itertools.pairwise(own[i]):
                self.meet[a.encode()[-1] << 8 | b.encode()[0]] = True
        self.chunks = W.Remembered(self._learn, bits)
        surface = [p.encode() for p in own]
        for i in np.flatnonzero(spec.kinds == CONTROL).tolist():
            surface[i] = b""
        for i in np.flatnonzero(spec.kinds == BYTE).tolist():
            surface[i] = bytes([int(spec.pieces[i][3:5], 16)])
        surface[self.unknown] = spec.unknown.encode()
        self.surface = _table(surface)
        self.decimal = _table([f"{i},".encode() for i in range(len(surface))])
        self.is_byte = spec.kinds == BYTE
        # pieces of which a space is taken away at the beginning of a text
        self.opens = np.array([k == NORMAL and s.startswith(b" ") for k, s in zip(spec.kinds.tolist(), surface, strict=True)])

    # encoding

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of the best score, the leftmost first, until no pair is a piece."""
        known = self.known
        if len(symbols) > LONG:
            return self._merge_long(symbols)
        best = [known.get(a + b) for a, b in itertools.pairwise(symbols)]
        while True:
            at, least = -1, None
            for k, x in enumerate(best):
                if x is not None and (least is None or x[0] < least):
                    at, least = k, x[0]
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            best[at : at + 1] = []
            if at:
                best[at - 1] = known.get(symbols[at - 1] + symbols[at])
            if at < len(best):
                best[at] = known.get(symbols[at] + symbols[at + 1])

    def _merge_long(self, symbols: list[str]) -> list[str]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (x := self.known.get(symbols[a] + symbols[b])) is not None:
                heap.append((x[0], a, len(symbols[a]) + len(symbols[b]), b)) if not started else heapq.heappush(heap, (x[0], a, len(symbols[a]) + len(symbols[b]), b))

        started = False
        for k in range(n - 1):
            offer(k, k + 1)
        heapq.heapify(heap)
        started = True
        while heap:
            _, a, size, b = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one of both has been merged since
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s]

    def _learn(self, chunks: list[bytes]) -> Pieces:
        ids, sizes, n = [], [], np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            text = chunk.decode()
            whole = self.known.get(text) if len(text) == 1 else None
            done = len(ids)
            for s in [text] if whole else self.merge(list(text)):
                known = self.known.get(s)
                if known is not None:
                    ids.append(known[1])
                    sizes.append(len(s.encode()))
                elif self.spec.byte_fallback:
                    raw = s.encode()
                    ids += self.bytes_[list(raw)].tolist()
                    sizes += [0] * (len(raw) - 1) + [len(raw)]
                else:
                    ids.append(self.unknown)
                    sizes.append(len(s.encode()))
            n[k] = len(ids) - done
        return Pieces(Ids(np.array(ids, np.int32), n), Ids(np.array(sizes, np.int32), n))

    def encode(self, column: pa.Array) -> Encoded:
        """Ids of each text of a string column; null is the empty text."""
        data, first, last = W.buffers(column)
        if len(data):
            data, first, last = self._valid(data, first, last)
        text = self.normaliser.run(data, first, last)
        own = text.data
        opens = (own & 0xC0) != 0x80
        if len(own):
            pairs = (own[:-1].astype(np.int64) << 8) | own[1:]
            opens[1:] &= ~self.meet[pairs]
            opens[text.first[text.first < text.last]] = True
        spans = _Spans(own, np.flatnonzero(opens))
        numbers = self.chunks.numbers(spans)
        ids, n = self.chunks.store.ids.take(numbers)
        size, _ = self.chunks.store.sizes.take(numbers)
        # chunks are in order of rows, and a piece ends where the next one begins
        upto = np.concatenate([[0], np.cumsum(n)])
        of = np.searchsorted(spans.begin, text.first), np.searchsorted(spans.begin, text.last)
        count = upto[of[1]] - upto[of[0]]
        ends = np.cumsum(size, dtype=np.int64)
        begins = ends - size
        origin = np.append(text.origin, 0)
        row = np.repeat(np.arange(len(count)), count)
        end = np.where(ends == text.last[row], text.end_origin[row], origin[np.minimum(ends, len(own))])
        begin = origin[begins]
        hollow = size == 0
        end[hollow] = begin[hollow]
        return Encoded(ids, count, begin, end)

    def _valid(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        try:
            data.tobytes().decode()
            return data, first, last
        except UnicodeDecodeError:
            texts = [data[a:b].tobytes().decode("utf-8", "pieces-replace").encode() for a, b in zip(first, last, strict=True)]
            n = np.array([len(t) for t in texts], np.int64)
            return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(n) - n, np.cumsum(n)

    # decoding

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The text of each row's ids, ``n`` ids a row, in UTF-8."""
        flat, begin, size = self.surface
        size = size[ids]
        own = gather(flat, begin[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = own.tobytes()
        byte = np.concatenate([[0], np.cumsum(self.is_byte[ids] & (flat[begin[ids]] >= 0x80 if len(flat) else False))])
        strips = self.normaliser.dummy_prefix or self.normaliser.remove_extra
        out = []
        for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            text = raw[ends[lo] : ends[hi]]
            if byte[hi] > byte[lo]:
                text = text.decode("utf-8", "pieces-replace").encode()
            if strips and text[:1] == b" ":
                text = self._stripped(text, ids[lo:hi])
            out.append(text)
        return out

    def _stripped(self, text: bytes, ids: np.ndarray) -> bytes:
        """``text`` without the space of its first visible piece; where the file removes extra spaces, without those of all pieces up to its first character."""
        for i in ids.tolist():
            if self.spec.kinds[i] == CONTROL:
                continue
            if not self.opens[i]:
                return text
            text = text[1:]
            if not self.normaliser.remove_extra or self.surface[2][i] > 1:
                return text
        return text


class _Spans:
    """Chunks of normalised texts, in the form in which words are remembered."""

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        self.data, self.begin, self.end = data, begin, np.append(begin[1:], len(data)) if len(begin) else begin

    def hashes(self) -> np.ndarray:
        return W.span_hashes(self.data, self.begin, self.end)


def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings in one array, and where each begins and its bytes."""
    n = np.array([len(r) for r in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(n) - n, n


def _replace(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def _register() -> None:
    import codecs

    codecs.register_error("pieces-replace", _replace)


_register()
_processors: dict[str, Processor] = {}


def processor(path: str) -> Processor:
    """One processor for each worker process and file."""
    if path not in _processors:
        _processors[path] = Processor(path)
    return _processors[path]


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, begins, ends`` for each row of ``docs`` (doc_id, text): pieces with their spans in the text's UTF-8 bytes."""
    path = path or vocabulary_path(FILE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(path)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                e = own.encode(batch.column(1)[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], _lists(e.ids, e.n), _lists(e.begin, e.n), _lists(e.end, e.n)], ["doc_id", "ids", "begins", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` for each row of ``rows`` (doc_id, ids); null ids are none."""
    path = path or vocabulary_path(FILE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(path)
        for batch in batches:
            ids = batch.column(1)
            n = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = own.decode(ids.flatten().to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.selectExpr("doc_id", "CAST(ids AS array<int>) AS ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered``: ids and what they decode to, as digests, and the original bytes in the pieces' spans."""
    path = path or vocabulary_path(FILE)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(path)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                e = own.encode(batch.column(1)[i:j])
                flat, begin, size = own.decimal
                listed = gather(flat, begin[e.ids], size[e.ids]).tobytes()
                upto = np.concatenate([[0], np.cumsum(e.n)])
                ends = np.concatenate([[0], np.cumsum(size[e.ids])])[upto].tolist()
                ids = [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in itertools.pairwise(ends)]
                texts = [hashlib.sha256(t).hexdigest() for t in own.decode(e.ids, e.n)]
                covered = np.concatenate([[0], np.cumsum(e.end - e.begin)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(e.n), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(covered[upto[1:]] - covered[upto[:-1]])], names)
            W.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_covered bigint")
