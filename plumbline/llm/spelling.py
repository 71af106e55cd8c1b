"""Groups of spelling variants: a trie self-join over a corpus's vocabulary.

Words are runs of Latin letters.  One in 97 occurrences, chosen by a hash of
document and run, loses one letter (the noise that the operator is to find
again).  Distinct words of enough letters and occurrences are the vocabulary.

Near words, at one inserted, deleted or replaced letter, come from a trie that
is joined with itself.  An active node of a trie node is one whose path is at
distance one at most; pairs of active nodes are propagated down all levels of
a trie at once, as arrays: two children of one node differ by a replaced
letter, a node and its child by an inserted one, and from there on both go
down by equal letters.  Where both are ends of words, the pair is a result.

The trie is partitioned by strata [i, j) of levels.  An edit within a stratum
leaves the first i letters equal and all behind the stratum, so the words of
one cell (prefix of i letters, rest behind j) make a trie of their own.
A word has three rows, whatever the size of the vocabulary: its first letters
with its rest (as long as they are or one longer), and its rest below its
prefix.  Cells that hold more words than ``cell`` are split into two strata
until they do not, or are one level high: these hold the letters of one place,
which the alphabet bounds.  Cells are sorted by Spark and read as a stream,
some thousand words at a time.

Of equal results of one insertion in a run of equal letters the last place
counts, so that every pair is found once.

Defined cases: a null text has no words; a null doc_id is the empty string in
the hash; repeated rows count one by one; very long runs are words like
others; a table without words gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import runs as R
from plumbline.llm import shared
from plumbline.llm import words as W

#: One occurrence in so many loses a letter.
ONE_IN = 97
MIN_LETTERS = 5
MIN_OCCURRENCES = 3
#: Levels of the first stratum.
HEAD = 4
#: Words of a cell that is not split any more.
CELL = 100_000
#: Words that are joined at once, whole cells together.
TOGETHER = 50_000
#: The level below all others.
END = 1 << 30

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _x = _i
    for _ in range(8):
        _x = (_x >> 1) ^ (0xEDB88320 if _x & 1 else 0)
    _CRC[_i] = _x


def crc32(data: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray, rounds: int = 48) -> np.ndarray:
    """Unsigned crc32 of each span, carried on from ``before``; long spans one by one."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    n = end - begin
    short = np.flatnonzero(n <= rounds)
    short = short[np.argsort(-n[short], kind="stable")]
    at, left, own = begin[short], n[short], state[short]
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k, "left"))  # those with more than k bytes
        own[:m] = _CRC[(own[:m] ^ data[at[:m] + k]) & 0xFF] ^ (own[:m] >> np.uint32(8))
    state[short] = own
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(n > rounds):
        out[k] = zlib.crc32(data[begin[k] : end[k]].tobytes(), int(before[k]))
    return out


def words(docs: DataFrame) -> DataFrame:
    """``word, n`` for each distinct word after the loss of letters; all lengths of at least one letter less than a word's."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = R.Counter()

        def out(groups, found, sums):
            return pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(sums[0])], ["word", "n"])

        for batch in batches:
            ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()]
            before = np.array(ids, np.uint32)
            for row, own in R.blocks(batch.column(1), R.latin):
                letters = own.end - own.begin
                leads = np.concatenate([[0], np.cumsum(own.data == 0xC3)])
                letters = letters - (leads[own.end] - leads[own.begin])
                which = np.flatnonzero(letters >= MIN_LETTERS)
                h = crc32(own.data, own.begin[which], own.end[which], before[own.rows()[which] + row])
                lost = h % ONE_IN == 0
                if lost.any():
                    short = []
                    for k, x in zip(which[lost].tolist(), h[lost].tolist(), strict=True):
                        run = own.data[own.begin[k] : own.end[k]].tobytes().decode()
                        short.append(run[: (p := x % len(run))] + run[p + 1 :])
                    yield pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array(np.ones(len(short), np.int64))], ["word", "n"])
                which = which[~lost]
                hashes = W.span_hashes(own.data, own.begin[which], own.end[which])
                for full in held.add(own, which, hashes, np.zeros(len(which), np.int8), [np.ones(len(which))]):
                    yield out(*full)
        for full in held.rest():
            yield out(*full)
        W.give_back()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """The tries of some cells, level by level.

    ``letters`` are code points of all words one after the other, which lie
    sorted by cell and then by letters; words of a cell are distinct.
    """

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, cell: np.ndarray):
        begin = np.cumsum(lengths) - lengths
        same = np.flatnonzero(cell[1:] == cell[:-1]) + 1
        # how many first letters each word shares with the one before; none in a new cell
        shared_ = np.zeros(len(lengths), np.int64)
        k, most = 0, np.minimum(lengths[same], lengths[same - 1])
        while len(same):
            go = most > k
            same, most = same[go], most[go]
            go = letters[begin[same] + k] == letters[begin[same - 1] + k]
            same, most, k = same[go], most[go], k + 1
            shared_[same] = k
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        node = np.cumsum(first) - 1
        which = np.arange(len(lengths))
        #: for each level: parent and letter of each node, the word that ends there (or -1), and where children begin
        self.parent, self.letter, self.ends, self.children = [np.zeros(int(first.sum()), np.int64)], [np.zeros(int(first.sum()), np.int64)], [], []
        for level in range(1 + int(lengths.max(initial=0))):
            ends = np.full(len(self.parent[level]), -1, np.int64)
            here = lengths[which] == level
            ends[node[here]] = which[here]
            self.ends.append(ends)
            which, node = which[~here], node[~here]
            # the next level's nodes; the first word below a node makes it
            new = shared_[which] <= level
            new[1:] |= node[1:] != node[:-1]
            new[:1] = True
            parent = node[new]
            self.parent.append(parent)
            self.letter.append(letters[begin[which[new]] + level].astype(np.int64))
            self.children.append(np.searchsorted(parent, np.arange(len(ends) + 1)))
            node = np.cumsum(new) - 1
        self.depth = len(self.ends)

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of ``nodes`` (on the next level), and for each the place of its parent in ``nodes``."""
        if level >= self.depth:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.children[level][nodes], self.children[level][nodes + 1]
        n = hi - lo
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return np.arange(total) + np.repeat(lo - (ends - n), n), np.repeat(np.arange(len(nodes)), n)

    def child(self, level: int, nodes: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or -1."""
        if level >= self.depth or not len(self.parent[level + 1]):
            return np.full(len(nodes), -1, np.int64)
        keys = self.parent[level + 1] * 256 + self.letter[level + 1]
        want = nodes * 256 + letter
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, at, -1)

    def down(self, a_level: int, a: np.ndarray, b_level: int, b: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of active pairs by equal letters, except the letter ``but``."""
        kids, of = self.below(a_level, a)
        letter = self.letter[a_level + 1][kids] if len(kids) else kids
        other = self.child(b_level, b[of], letter)
        ok = other >= 0
        if but is not None:
            ok &= letter != but[of]
        return kids[ok], other[ok]

    def end(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.ends[level][nodes] if level < self.depth else np.full(len(nodes), -1, np.int64)


def near(letters: np.ndarray, lengths: np.ndarray, cell: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of words of a cell at distance one, each pair once.

    ``longer`` marks words that have one letter more than their stratum: two
    of them are not compared, and if that letter is their last the pair
    belongs to the next stratum, as what stands before it is equal.
    """
    trie = Trie(letters, lengths, cell)
    none = np.zeros(0, np.int64)
    replaced, inserted, found = (none, none), (none, none), []

    def take(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> None:
        ok = ok & (a >= 0) & (b >= 0)
        found.append((a[ok], b[ok]))

    for level in range(trie.depth):
        nodes = np.arange(len(trie.parent[level]))
        kids, of = trie.below(level, nodes)
        deep = level + 1
        # a node and its child: one letter more; an equal one must not follow, since that would be a later place
        a, b = trie.end(level, nodes[of]), trie.end(deep, kids)
        more = trie.letter[deep][kids] if len(kids) else none
        take(a, b, ~longer[b])
        one_more = trie.down(level, nodes[of], deep, kids, more)
        # pairs that came from above go down by equal letters
        go = trie.down(level, *(inserted[0], deep), inserted[1])
        inserted = tuple(np.concatenate(x) for x in zip(go, one_more, strict=True))
        go = trie.down(level, replaced[0], level, replaced[1])
        # two children of one node: one letter replaced
        n = np.diff(trie.children[level])
        left = n[of] - 1 - (np.arange(len(kids)) - trie.children[level][of])  # younger children of the same node
        ends = np.cumsum(left)
        total = int(ends[-1]) if len(ends) else 0
        x = np.repeat(kids, left)
        y = x + 1 + np.arange(total) - np.repeat(ends - left, left)
        replaced = np.concatenate([go[0], x]), np.concatenate([go[1], y])
        a, b = trie.end(deep, replaced[0]), trie.end(deep, replaced[1])
        take(a, b, ~(longer[a] & longer[b]))
        a, b = trie.end(deep, inserted[0]), trie.end(deep + 1, inserted[1])
        take(a, b, np.ones(len(a), bool))
    return tuple(np.concatenate([f[k] for f in found]) if found else none for k in (0, 1))


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points below U+0100 of a string column one after the other, and how many each row has."""
    data, first, last = W.buffers(column)
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    points = np.where(after, data | 0xC0, data)[~lead]
    leads = np.concatenate([[0], np.cumsum(lead)])
    return points, last - first - (leads[last] - leads[first])


CELL_KEY = ["lo", "hi", "prefix", "rest"]


def _cell(lo: str, hi: str, prefix: str, rest: str, middle: str, longer: str):
    return F.expr(f"named_struct('lo', CAST({lo} AS INT), 'hi', CAST({hi} AS INT), 'prefix', {prefix}, 'rest', {rest}, 'middle', {middle}, 'longer', {longer})")


def _dealt(words_: DataFrame, rows: list[tuple]) -> DataFrame:
    """One row for each of ``rows`` (condition, cell) that holds for a word."""
    made = F.filter(F.array(*(F.when(F.expr(ok), cell) for ok, cell in rows)), lambda x: x.isNotNull())
    return words_.select(F.explode(made).alias("r"), "n").select("r.*", "n")


def _strata(vocabulary: DataFrame, head: int) -> DataFrame:
    """Each word's rows in the strata [0, head) and [head, end)."""
    return _dealt(vocabulary, [
        ("true", _cell("0", f"{head}", "''", f"substring(word, {head + 1})", f"substring(word, 1, {head})", "false")),
        (f"length(word) > {head}", _cell("0", f"{head}", "''", f"substring(word, {head + 2})", f"substring(word, 1, {head + 1})", "true")),
        (f"length(word) >= {head}", _cell(f"{head}", f"{END}", f"substring(word, 1, {head})", "''", f"substring(word, {head + 1})", "false")),
    ])


def _halves(member: DataFrame, head: int) -> DataFrame:
    """The rows of cells [lo, hi) as rows of [lo, mid) and [mid, hi)."""
    member = member.withColumn("high", F.expr(f"CASE WHEN hi = {END} THEN {head} ELSE CAST((hi - lo) / 2 AS INT) END"))
    return _dealt(member, [
        ("NOT longer", _cell("lo", "lo + high", "prefix", "concat(substring(middle, high + 1), rest)", "substring(middle, 1, high)", "false")),
        # one letter more: words that had it in the whole stratum, and those that end within it
        ("longer OR rest = '' AND length(middle) > high", _cell("lo", "lo + high", "prefix", "concat(substring(middle, high + 2), rest)", "substring(middle, 1, high + 1)", "true")),
        ("length(middle) >= high", _cell("lo + high", "hi", "concat(prefix, substring(middle, 1, high))", "rest", "substring(middle, high + 1)", "longer")),
    ])


def cells(vocabulary: DataFrame, head: int = HEAD, cell: int = CELL) -> DataFrame:
    """Rows ``lo, hi, prefix, rest, middle, longer, n`` of all words, dealt to cells of at most ``cell`` rows or one level."""
    open_, done = _strata(vocabulary, head), None
    while True:
        large = shared.checkpointed(open_.groupBy(CELL_KEY).count().where((F.col("count") > cell) & (F.col("hi") - F.col("lo") > 1)).select(CELL_KEY))
        last = large.isEmpty()
        small = open_ if last else open_.join(large, CELL_KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        open_ = shared.written(_halves(open_.join(large, CELL_KEY, "left_semi"), head), "cells")


def _changes(table: pa.Table) -> np.ndarray:
    """Whether each row but the first begins a new cell."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in CELL_KEY:
        own = table.column(name).combine_chunks()
        out |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
    return out


def _joined(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Both directions of all near pairs of some whole cells, which lie in order."""
    if table.num_rows < 2:
        return
    new = np.concatenate([[True], _changes(table)])
    cell = np.cumsum(new) - 1
    table = table.filter(pa.array(np.bincount(cell)[cell] > 1))  # a word alone in its cell has no pair there
    if not table.num_rows:
        return
    cell = np.unique(cell[np.bincount(cell)[cell] > 1], return_inverse=True)[1]
    letters, lengths = code_points(table.column("middle").combine_chunks())
    longer = table.column("longer").combine_chunks().to_numpy(zero_copy_only=False)
    a, b = near(letters, lengths, cell, longer)
    word = pc.binary_join_element_wise(*(table.column(c).combine_chunks() for c in ("prefix", "middle", "rest")), "")
    n = table.column("n").combine_chunks()
    for i in range(0, len(a), 1 << 16):
        x, y = (pa.array(np.concatenate([p[i : i + (1 << 16)], q[i : i + (1 << 16)]])) for p, q in ((a, b), (b, a)))
        yield pa.RecordBatch.from_arrays([word.take(x), word.take(y), n.take(y)], ["word", "near", "near_n"])


def near_pairs(vocabulary: DataFrame, head: int = HEAD, cell: int = CELL, together: int = TOGETHER) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of words of ``vocabulary`` (word, n; words distinct) at distance one."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= together:
                table = pa.Table.from_batches(held)
                new = np.flatnonzero(_changes(table)) + 1
                if len(new):  # up to where the last cell begins, which may go on
                    yield from _joined(table.slice(0, int(new[-1])))
                    held = table.slice(int(new[-1])).combine_chunks().to_batches()
        if held:
            yield from _joined(pa.Table.from_batches(held))
        W.give_back()

    dealt = cells(vocabulary, head, cell).repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "middle")
    return dealt.mapInArrow(join, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each row of ``forms`` (word, form): where the chain of forms that begins at a word ends.

    A form's count is at least twice its word's, so chains have no circles and
    at most as many steps as counts have bits; each round doubles the steps.
    """
    now = shared.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = shared.written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of the texts of ``docs`` (doc_id, text)."""
    if min_letters < MIN_LETTERS:
        raise ValueError(f"words of fewer than {MIN_LETTERS} letters are not counted")
    vocabulary = shared.written(words(docs).where((F.length("word") >= min_letters) & (F.col("n") >= min_occurrences)), "vocabulary")
    best = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    formed = F.expr("-best.k >= 2 * n")
    out = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.k")).alias("form_n")
    )
    out = shared.written(out, "variants")
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
