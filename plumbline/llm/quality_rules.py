"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a document from counts over its whole text.  Rules
name the counts that they need, and each count has a cost: operations for each
byte, word or line that making it touches, what it is made from included if
that isn't there yet.  On a bounded sample the cascade is laid out step by
step: next comes the rule with the most rejections, among the documents that
are left, for what its missing counts cost.  Rules then run in that order, each
over the documents that no earlier rule has rejected, and counts are made when
they are first asked for, so that later counts are made for fewer documents.
The order changes the work only: a document is kept if no rule rejects it.
Costs are counted and not timed, so that runs over the same rows agree in the
order, and in ``rejected_by``.

Defined cases: a null text is the empty one (no words, rejected by
``min_words``); repeated rows are judged one by one; ties of rank keep the
order in which the rules were given; a table without rows gives no rows, and
its cascade keeps the given order.  Columns of the input other than the text
are carried through by ``cascade``; a result column that clashes with one of
them replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import words as W

#: The sample: the distinct texts of the smallest hashes, in whatever order rows lie, among those with so many bytes at
#: most.  The order of rules changes no verdict.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 1 << 16

#: A block is packed anew when less than this share of its rows is left.
REPACK = 0.75

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
LETTER = UPPER | LOWER | (np.arange(256) >= 128)
#: Bytes that begin a code point.
HEADS = (np.arange(256) & 0xC0) != 0x80


class Texts:
    """A block of rows; what the rules need of it is made once, on demand."""

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.data, self.first, self.last = data, first, last
        self._made: dict[str, np.ndarray] = {}

    def only(self, keep: np.ndarray) -> "Texts":
        """The rows marked in ``keep``, copied next to each other."""
        first, last = self.first[keep], self.last[keep]
        sizes = last - first
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        out = Texts(self.data[at], ends - sizes, ends)
        out._made = {k: v[keep] for k, v in self._made.items() if k.startswith(("n_", "word_"))}
        return out

    def __len__(self) -> int:
        return len(self.first)

    def get(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Marked bytes of each row."""
        at = np.flatnonzero(flags)
        return np.searchsorted(at, self.last - self.first[:1]) - np.searchsorted(at, self.first - self.first[:1])

    def _bytes(self) -> np.ndarray:
        return self.data[self.first[0] : self.last[-1]] if len(self) else self.data[:0]

    def _words(self) -> W.Words:
        return W.Words(self.data, self.first, self.last)

    def _n_words(self) -> np.ndarray:
        return self.get("words").count

    def _word_chars(self) -> np.ndarray:
        b = self.get("bytes")
        return self.per_row(HEADS[b] & ~W.SPACE[b])

    def _n_symbols(self) -> np.ndarray:
        return self.per_row(SYMBOLS[self.get("bytes")])

    def _n_upper(self) -> np.ndarray:
        return self.per_row(UPPER[self.get("bytes")])

    def _n_lower(self) -> np.ndarray:
        return self.per_row(LOWER[self.get("bytes")])

    def _n_lines(self) -> np.ndarray:
        """Lines that have a word."""
        return np.bincount(self.get("lines")[0], minlength=len(self))

    def _line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row, begin and end of each line that has a word."""
        b, base = self.get("bytes"), self.first[:1]
        breaks = np.flatnonzero(b == 10)
        begins = np.unique(np.concatenate([breaks + 1, self.first - base]))
        begins = begins[begins < len(b)]
        row = np.searchsorted(self.last - base, begins, "right")
        ends = np.minimum(np.append(breaks, len(b))[np.searchsorted(breaks, begins)], (self.last - base)[row])
        worded = np.searchsorted(self.get("words").begin, ends) > np.searchsorted(self.get("words").begin, begins)
        return row[worded], begins[worded], ends[worded]

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The row and the hash of each line that has a word."""
        row, begin, end = self.get("line_spans")
        return row, W.span_hashes(self.get("bytes"), begin, end)

    def _n_bullets(self) -> np.ndarray:
        """Lines whose first word begins with - or * or a bullet."""
        row, begin, _ = self.get("line_spans")
        b, w = np.append(self.get("bytes"), np.zeros(2, np.uint8)), self.get("words")
        at = w.begin[np.searchsorted(w.begin, begin)] if len(row) else begin
        marked = (b[at] == 0x2D) | (b[at] == 0x2A) | ((b[at] == 0xE2) & (b[at + 1] == 0x80) & (b[at + 2] == 0xA2))
        return np.bincount(row[marked], minlength=len(self))

    def _n_ellipses(self) -> np.ndarray:
        """Lines whose last word ends in three dots or their one character."""
        row, _, end = self.get("line_spans")
        b, w = self.get("bytes"), self.get("words")
        last = np.searchsorted(w.begin, end) - 1
        at = w.end[last] if len(row) else end
        long = at - w.begin[last] >= 3 if len(row) else np.zeros(0, bool)
        row, at = row[long], at[long]
        marked = ((b[at - 3] == 0x2E) & (b[at - 2] == 0x2E) & (b[at - 1] == 0x2E)) | ((b[at - 3] == 0xE2) & (b[at - 2] == 0x80) & (b[at - 1] == 0xA6))
        return np.bincount(row[marked], minlength=len(self))

    def _n_letter_words(self) -> np.ndarray:
        """Words with a letter; characters beyond ASCII count as letters."""
        w = self.get("words")
        upto = np.append(0, np.cumsum(LETTER[self.get("bytes")]))
        return np.bincount(w.rows()[upto[w.end] > upto[w.begin]], minlength=len(self))

    def _n_dup_lines(self) -> np.ndarray:
        row, line = self.get("lines")
        order = np.lexsort((line, row))
        again = (row[order][1:] == row[order][:-1]) & (line[order][1:] == line[order][:-1])
        return np.bincount(row[order][1:][again], minlength=len(self))

    def _n_repeat_words(self) -> np.ndarray:
        """Words inside windows of three words that the row has twice or more."""
        w = self.get("words")
        h = w.hashes()
        if len(h) < 3:
            return np.zeros(len(self), np.int64)
        row = w.rows()
        whole = row[2:] == row[:-2]
        key = W.mix(h[:-2] * W._PLACE[0] + h[1:-1] * W._PLACE[1] + h[2:] * W._PLACE[2] + row[:-2].astype(np.uint64) * W._PLACE[3])
        at = np.flatnonzero(whole)
        order = at[np.argsort(key[at])]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = twice.copy()
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        return np.bincount(row[covered], minlength=len(self))


#: What each count is made from, and the operations that it takes for each byte, word and line of a text.
COSTS: dict[str, tuple[tuple[str, ...], tuple[int, int, int]]] = {
    "bytes": ((), (0, 0, 0)),
    "words": ((), (6, 2, 0)),
    "n_words": (("words",), (0, 0, 0)),
    "word_chars": (("bytes",), (4, 0, 0)),
    "n_symbols": (("bytes",), (2, 0, 0)),
    "n_upper": (("bytes",), (2, 0, 0)),
    "n_lower": (("bytes",), (2, 0, 0)),
    "line_spans": (("bytes", "words"), (1, 0, 8)),
    "lines": (("line_spans",), (5, 0, 4)),
    "n_lines": (("lines",), (0, 0, 1)),
    "n_dup_lines": (("lines",), (0, 0, 20)),
    "n_bullets": (("line_spans",), (0, 0, 8)),
    "n_ellipses": (("line_spans",), (0, 0, 12)),
    "n_letter_words": (("words",), (2, 6, 0)),
    "n_repeat_words": (("words",), (5, 30, 0)),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a flag for each row of a block, from the counts ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Texts], np.ndarray]


def _share(part: np.ndarray, whole: np.ndarray, least: float) -> np.ndarray:
    return part > least * whole


def min_words(least: int = 50) -> Rule:
    return Rule("min_words", ("n_words",), lambda t: t.get("n_words") < least)


def repeated_words(percent: int = 50) -> Rule:
    return Rule("repeated_words", ("n_repeat_words", "n_words"), lambda t: 100 * t.get("n_repeat_words") > percent * t.get("n_words"))


def symbols_per_word(most: float = 0.3) -> Rule:
    """Symbols such as # $ % and the bars of tables, to words."""
    return Rule("symbols_per_word", ("n_symbols", "n_words"), lambda t: _share(t.get("n_symbols"), t.get("n_words"), most))


def word_length(least: float = 2.0, most: float = 20.0) -> Rule:
    """Mean code points of a word."""
    return Rule("word_length", ("word_chars", "n_words"), lambda t: (t.get("word_chars") < least * t.get("n_words")) | (t.get("word_chars") > most * t.get("n_words")))


def upper_case(most: float = 0.6) -> Rule:
    """A-Z among the letters A-Z and a-z."""
    return Rule("upper_case", ("n_upper", "n_lower"), lambda t: _share(t.get("n_upper"), t.get("n_upper") + t.get("n_lower"), most))


def duplicate_lines(most: float = 0.3) -> Rule:
    """Lines equal to an earlier line of the text, among its lines with a word."""
    return Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda t: _share(t.get("n_dup_lines"), t.get("n_lines"), most))


def bullet_lines(most: float = 0.9) -> Rule:
    """Lines that begin as items of a list, among the lines with a word."""
    return Rule("bullet_lines", ("n_bullets", "n_lines"), lambda t: _share(t.get("n_bullets"), t.get("n_lines"), most))


def ellipsis_lines(most: float = 0.3) -> Rule:
    """Lines that are cut off by dots, among the lines with a word."""
    return Rule("ellipsis_lines", ("n_ellipses", "n_lines"), lambda t: _share(t.get("n_ellipses"), t.get("n_lines"), most))


def wordless(least: float = 0.5) -> Rule:
    """Words with a letter, among all."""
    return Rule("wordless", ("n_letter_words", "n_words"), lambda t: t.get("n_letter_words") < least * t.get("n_words"))


BASE_RULES = (min_words(), repeated_words())
RULES = (*BASE_RULES, symbols_per_word(), word_length(), upper_case(), duplicate_lines(), bullet_lines(), ellipsis_lines(), wordless())
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def missing(needs: Iterable[str], made: Iterable[str]) -> set[str]:
    """The counts that are to be made for ``needs`` where those of ``made`` are there."""
    out: set[str] = set()
    for name in needs:
        if name not in made and name not in out:
            out |= {name} | missing(COSTS[name][0], {*made, *out})
    return out


def ordered(rules: Sequence[Rule], texts: Texts, made: Iterable[str] = ()) -> list[tuple[Rule, float, float]]:
    """Rules in the order in which the cascade runs them, each with its cost (operations a document) and the share that it rejects, of the documents that come to it."""
    made, left, out = {x for m in made for x in (m, *missing(COSTS[m][0], ()))}, list(rules), []
    alive = np.ones(len(texts), bool)
    bad = {r.name: np.asarray(r.rejects(texts)) for r in left}
    sizes = np.stack([texts.last - texts.first, texts.get("n_words"), texts.get("n_lines")]) if len(texts) else np.zeros((3, 0))
    while left:
        n = max(int(alive.sum()), 1)
        mean = sizes[:, alive].sum(axis=1) / n
        cost = [sum(float(np.dot(COSTS[m][1], mean)) for m in sorted(missing(r.needs, made))) for r in left]
        share = [float((bad[r.name] & alive).sum()) / n for r in left]
        k = min(range(len(left)), key=lambda k: (-share[k] / (cost[k] + 1), k))
        rule = left.pop(k)
        out.append((rule, cost[k], share[k]))
        made |= missing(rule.needs, made)
        alive &= ~bad[rule.name]
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", made: Iterable[str] = (), sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order in which the cascade runs them, from a sample of ``sample_rows`` rows at most; ``made``: counts that are made in any case."""
    column = F.col(f"`{text}`")
    n, least = docs.count(), F.shiftrightunsigned(F.xxhash64(column), 1)
    share, rows = min(1.0, 2 * sample_rows / max(n, 1)), []
    while True:  # copies share a hash and count once, so that a look collects few rows; where most rows are copies it takes more than one
        some = docs.where((F.octet_length(column) <= SAMPLE_BYTES) & (least <= F.lit(min(int(share * 2**63), 2**63 - 1)))).groupBy(least.alias("h")).agg(F.min(column).alias("text"))
        rows = [r["text"] for r in some.orderBy("h").limit(sample_rows).collect()]
        if len(rows) == sample_rows or share >= 1:
            break
        share = min(1.0, 4 * share)
    return [r for r, _, _ in ordered(rules, Texts(*W.buffers(pa.array(rows, pa.large_string()))), made)]


def run(rules: Sequence[Rule], texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is kept, and the number in ``rules`` of the rule that rejected it (-1: none)."""
    by = np.full(len(texts), -1, np.int32)
    alive, left, open_ = np.arange(len(texts)), texts, np.ones(len(texts), bool)
    for k, rule in enumerate(rules):
        bad = rule.rejects(left) & open_
        by[alive[bad]] = k
        open_ &= ~bad
        if not open_.any():
            break
        if open_.mean() < REPACK:
            left, alive = left.only(open_), alive[open_]
            open_ = np.ones(len(left), bool)
    return by < 0, by


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with ``kept`` boolean and ``rejected_by`` string (null where kept).

    ``rules``: in the order in which they run; None: ``RULES`` as ``plan`` orders
    them.  ``report`` adds the counts of ``REPORT`` and ``base_failed``, for kept
    and rejected rows alike.
    """
    rules = plan(docs, RULES, text, REPORT if report else ()) if rules is None else list(rules)
    added = [T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]
    if report:
        added += [T.StructField(n, T.LongType()) for n in REPORT] + [T.StructField("base_failed", T.BooleanType())]
    new = {f.name.lower() for f in added}
    kept_fields = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept_fields, *added])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept_fields], F.col(f"`{text}`").alias("__text"))
    names = [f.name for f in kept_fields]
    labels = np.array([r.name for r in rules], object)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, first, last = W.buffers(batch.column(batch.num_columns - 1))
            parts: list[list[np.ndarray]] = []
            for i, j in W.blocks(first, last):
                texts = Texts(data, first[i:j], last[i:j])
                if report:
                    # they are asked for in any case, so that rules over them cost nothing and the others see fewer texts
                    for n in REPORT:
                        texts.get(n)
                kept, by = run(rules, texts)
                part = [kept, by]
                if report:
                    counts = [texts.get(n).astype(np.int64) for n in REPORT]
                    part += [*counts, (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])]
                parts.append(part)
            if not parts:
                continue
            whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
            why = np.where(whole[1] < 0, None, labels[np.maximum(whole[1], 0)] if len(labels) else None)
            columns = [*batch.columns[: len(names)], pa.array(whole[0]), pa.array(why, pa.string()), *map(pa.array, whole[2:])]
            yield pa.RecordBatch.from_arrays(columns, [*names, *[f.name for f in added]])
        W.give_back(True)

    return source.mapInArrow(judge, schema)
