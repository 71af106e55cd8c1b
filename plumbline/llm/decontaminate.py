"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, and every run of characters other
than letters and digits is one space.  An item of m characters may differ from
a passage in ``budget = floor(rate * m)`` edits of characters.  It is cut into
budget + 1 pieces; whatever the edits, one piece at least stands in the
passage unchanged.  All pieces are looked for at once by an Aho-Corasick
automaton, each hit names the only place where the item could stand, and that
place is verified by Myers' bit-parallel edit distance.

Items are a stated query set: they are read in blocks of at most
``BLOCK_CHARS`` characters, and each block is held against all documents in
one scan without any shuffle.  Only such a block is held by the driver and
sent to the executors.

Defined cases: null and empty texts match nothing; an item without a letter or
digit is never found; an item so short that its budget is 0 must stand between
word boundaries; repeated items and repeated rows are matched one by one; of
several places of an item in a text, the one with the smallest distance, then
the first one, is given; empty tables give no matches.  Extra columns are not
read by ``matches`` and are carried by ``clean``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import words as W

#: Edits allowed for each character of an item.
RATE = 0.05
#: Characters of items that are searched for in one scan.
BLOCK_CHARS = 4 << 20
_OTHER = re.compile(r"[\W_]+")


_tables: list[np.ndarray] = []


def _planes() -> list[np.ndarray]:
    """For the code points below U+10000: lower case (0 where it isn't one code point, or depends on its neighbours), and whether it is a letter or digit."""
    if not _tables:
        lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 and c != 0x3A3 else 0 for c in range(1 << 16)], np.uint32)
        _tables.extend([lower, np.array([_OTHER.match(chr(c)) is None for c in range(1 << 16)])])
    return _tables


def normal(text: str | None) -> str:
    """Lower case with one space between runs of letters and digits."""
    if not text:
        return ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lower, inside = _planes()
    if points.max() >= 1 << 16 or not (low := lower[points]).all():
        return _OTHER.sub(" ", text.lower()).strip()
    ok = inside[low]
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    low[~ok] = 32
    return low[keep].tobytes().decode("utf-32-le", "surrogatepass").strip()


def pieces(m: int, budget: int) -> list[tuple[int, int]]:
    """Where budget + 1 pieces of nearly the same length begin and end."""
    cuts = [m * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Pattern:
    """One item's text, with the bit vectors of Myers' algorithm for it and for its reverse."""

    def __init__(self, text: str):
        self.text, self.m = text, len(text)
        self.ahead, self.back = self._bits(text), self._bits(text[::-1])
        self.all, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    @staticmethod
    def _bits(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def _run(self, bits: dict[str, int], text: str, anchored: bool) -> tuple[int, int]:
        """The smallest distance of the pattern to a part of ``text`` that ends at some place (and begins at 0 if ``anchored``), and the first such place."""
        plus, minus, at, every, top = self.all, 0, self.m, self.all, self.top
        best, where = self.m, 0
        for i, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(across | plus), plus & across
            if up & top:
                at += 1
            elif down & top:
                at -= 1
            up = (up << 1 | anchored) & every
            down = down << 1 & every
            plus = (down | ~(vertical | up)) & every
            minus = up & vertical
            if at < best:
                best, where = at, i
        return best, where

    def best(self, text: str) -> tuple[int, int, int]:
        """Distance, begin and end of the part of ``text`` that is nearest to the pattern."""
        distance, end = self._run(self.ahead, text, False)
        _, length = self._run(self.back, text[:end][::-1], True)
        return distance, end - length, end


class Matcher:
    """A block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[Any, str]], rate: float = RATE):
        import ahocorasick

        self.items: list[tuple[Any, Pattern, int]] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(rate * len(text))
            text = text if budget else f" {text} "
            for a, b in pieces(len(text), budget):
                where.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, Pattern(text), budget))
        self.automaton = None
        if where:
            self.automaton = ahocorasick.Automaton()
            for piece, places in where.items():
                self.automaton.add_word(piece, (len(piece), places))
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[Any, int, int, int]]:
        """Item, distance, begin and end (in the normalised text) of each item that stands in the text."""
        text = f" {normal(text)} "
        if self.automaton is None or len(text) < 3:
            return []
        places: dict[int, set[int]] = {}
        for end, (size, known) in self.automaton.iter(text):
            for item, offset in known:
                places.setdefault(item, set()).add(end + 1 - size - offset)
        out = []
        for item in sorted(places):
            item_id, pattern, budget = self.items[item]
            best, spans = None, []
            for at in sorted(places[item]):
                lo, hi = max(0, at - budget), min(len(text), at + pattern.m + budget)
                if spans and lo <= spans[-1][1] - pattern.m + budget:  # nearly the same place
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                distance, begin, end = pattern.best(text[lo:hi])
                if distance <= budget and (best is None or distance < best[0]):
                    # an item without a budget was looked for with the spaces around it
                    best = (distance, lo + begin + (not budget), lo + end - (not budget))
            if best:
                out.append((item_id, best[0], max(best[1] - 1, 0), best[2] - 1))
        return out


_matchers: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple[Any, str]], rate: float) -> Matcher:
    """One matcher for each worker process and block of items."""
    key = (rate, hash(tuple(items)))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, rate)
    return _matchers[key]


def item_blocks(items: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[Any, str]]]:
    """Blocks of (item_id, text) of at most ``most`` characters, or of one item."""
    block: list[tuple[Any, str]] = []
    size = 0
    for row in items.select("item_id", "text").toLocalIterator():
        text = row["text"] or ""
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, begin, end, budget`` for each row of ``docs`` and item that stands in it."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for block in item_blocks(items):

        def find(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = _matcher(block, rate)
            for batch in batches:
                rows, got = [], []
                for r, text in enumerate(batch.column(1)):
                    found = own.find(text.as_py())
                    rows += [r] * len(found)
                    got += found
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                item, distance, begin, end = zip(*got, strict=True) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_type), *(pa.array(x, pa.int32()) for x in (distance, begin, end))], ["doc_id", "item_id", "distance", "begin", "end"])

        item_type = to_arrow_type(items.schema["item_id"].dataType)
        part = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {doc_kind}, item_id {item_kind}, distance int, begin int, end int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` in which no item stands."""
    for block in item_blocks(items):

        def keep(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = _matcher(block, rate)
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                yield batch.filter(pa.array([not own.find(t.as_py()) for t in texts], pa.bool_())).select(range(batch.num_columns - 1))
            W.give_back(True)

        columns = [F.col(f"`{c}`") for c in docs.columns]
        docs = docs.select(*columns, F.col("text").alias("__text")).mapInArrow(keep, docs.schema)
    return docs
