r"""Line dedup over content-defined chunks of lines.

A text's lines (cut at \n) are hashed, and a rolling hash runs over the hashes
of the last ``window`` lines.  A chunk ends after a line at which the rolling
hash falls on one residue of ``lines``, unless it does so at the line before
too; so chunks have two lines at least (but for a text's last one) and
``lines`` + 1 or so on average, and an inserted or deleted line moves the
boundaries next to it alone.  A text is cut ``cuts`` times, by as many
functions of the rolling hash, so that a short run that no chunk of one cut
lies in holds one of another.  Chunks of two lines or more, with a word, that
occur anywhere else, in the same text or another, are removed after their
bytes have been compared with those of the first occurrence, which stays:
first by doc_id, then by the text's hash, then by place.

A chunk at the border of a repeated block has lines of its surroundings in it.
So a chunk that goes takes with it the lines before and behind it, up to
``REACH`` on either side, as long as each equals the line at the same distance
from the first occurrence.  A removed line always has an equal one before it,
so one of each stays.  A single line between lines that differ is no run and
stays, and so does a chunk that overlaps its first occurrence.

``extend`` finds every run of two repeated lines or more, which no choice of
cuts does.  A text is then cut once, into chunks of ``RUN`` pairs of lines on
average that share the line at their border, so that each pair of lines that
follow each other is in one chunk.  Chunks that repeat an earlier one, byte by
byte, go whole.  The pairs of the chunks that stay are compared in the same
way, one by one: a pair's first place is in a chunk that stays, since a chunk
that goes has an earlier equal.  A pair without a word is in no chunk.

Counting moves a few numbers for each chunk.  Bytes move for chunks whose hash
occurs twice.  A chunk in a third of all documents is added up before the
shuffle, and where its members meet the one that stays, it is dealt to
``SALTS`` places.

Defined cases: a null text stays null and has no lines; an empty text has one
empty line and stays; chunks without a word stay; rows that agree in doc_id
and text are one document given twice and are treated alike; a null doc_id
comes before all others; a table without rows gives none.  Other columns are
carried, whatever their names; a column ``removed_lines`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm import words as W

#: Lines between boundaries on average, lines that the rolling hash sees, and how often a text is cut.
LINES, WINDOW, CUTS = 2, 2, 4
#: Lines on either side of a chunk that go with it.
REACH = 6
#: Pairs of lines in a chunk on average where each pair is in one chunk.
RUN = 4
#: Occurrences of a chunk from which they are dealt to several places, and how many.
HOT, SALTS = 5000, 32


def line_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin, end and hash of each line of rows that begin with the first byte of ``data``."""
    breaks = np.flatnonzero(data == 10)
    # every row has a line at its start, and one after each break
    row = np.concatenate([np.arange(len(first)), np.searchsorted(last, breaks, "right")])
    begin = np.concatenate([first, breaks + 1])
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], last[row])
    h = np.zeros(len(row), np.uint64)
    full = end > begin
    h[full] = W.span_hashes(data, begin[full], end[full])
    return row, begin, end, h


def chunk_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, lines: int = LINES, window: int = WINDOW, cuts: int = CUTS) -> tuple[np.ndarray, ...]:
    """Row, number of the first line, lines and hash of each chunk of two lines or more that has a word."""
    data, base = data[first[0] : last[-1]], first[0]
    row, begin, end, h = line_spans(data, first - base, last - base)
    worded = np.append(0, np.cumsum(~W.SPACE[data]))
    rolling = np.zeros(len(h), np.uint64)
    for k in range(window):
        same = row[k:] == row[: len(row) - k]
        rolling[k:][same] += h[: len(h) - k][same] * W._PLACE[k]
    head = np.append(True, row[1:] != row[:-1])
    own = np.arange(len(row)) - np.searchsorted(row, row)
    found = []
    for k in range(cuts):
        cut = (W.mix(rolling + W._PLACE[window + k]) % np.uint64(lines) == 0) & ~head
        # of several lines in a row that would end a chunk every second one does, so that chunks have two lines
        run = np.arange(len(cut)) - np.maximum.accumulate(np.where(cut, -1, np.arange(len(cut))))
        cut &= run % 2 == 1
        starts = head.copy()
        starts[1:] |= cut[:-1]
        at = np.flatnonzero(starts)
        stop = np.append(at[1:], len(row))
        good = (stop - at > 1) & (worded[end[stop - 1]] > worded[begin[at]])
        found.append(at[good] * (len(row) + 1) + stop[good])
    at, stop = np.divmod(np.unique(np.concatenate(found)) if found else np.empty(0, np.int64), len(row) + 1)
    # a chunk's hash is made from those of its lines
    up, down = W.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(W.mix(h) * up[: len(h)], out=sums[1:])
    value = W.mix((sums[stop] - sums[at]) * down[at] + (stop - at).astype(np.uint64))
    return row[at], own[at], stop - at, value


def run_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Row, number of the first line, lines and hash of each chunk of pairs of lines, where the pairs of each begin in the last array, and the pairs' hashes.

    A pair that the rolling hash over its two lines picks ends a chunk, and so
    does a text's last pair and one before a pair without a word.
    """
    data, base = data[first[0] : last[-1]], first[0]
    row, begin, end, h = line_spans(data, first - base, last - base)
    worded = np.append(0, np.cumsum(~W.SPACE[data]))
    at = np.flatnonzero(row[1:] == row[:-1])
    at = at[worded[end[at + 1]] > worded[begin[at]]]
    pair = W.mix(h[at] * W._PLACE[0] + h[at + 1] * W._PLACE[1])
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (pair, np.zeros(1, np.int64), pair)
    stops = W.mix(pair + W._PLACE[WINDOW]) % np.uint64(run) == 0
    stops |= np.append(at[1:] != at[:-1] + 1, True)
    ends = np.flatnonzero(stops) + 1
    starts = np.append(0, ends[:-1])
    up, down = W.powers(len(at) + 1)
    sums = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(W.mix(pair) * up[: len(at)], out=sums[1:])
    value = W.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    of = row[at[starts]]
    return of, at[starts] - np.searchsorted(row, of), ends - starts + 1, value, np.append(starts, len(at)), pair


def chunks(docs: DataFrame, extend: bool = False) -> DataFrame:
    """``doc_id, t, number, n_lines, h``: t is the text's hash; with ``extend`` chunks of pairs of lines, and the pairs' hashes as ``pairs``."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, first, last = W.buffers(batch.column(2))
            for i, j in W.blocks(first, last):
                if extend:
                    row, number, n, h, starts, pair = run_spans(data, first[i:j], last[i:j])
                    more = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(pair.view(np.int64)))]
                else:
                    row, number, n, h = chunk_spans(data, first[i:j], last[i:j])
                    more = []
                at = pa.array(row + i)
                ints = [pa.array(x.astype(np.int32)) for x in (number, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *ints, pa.array(h.view(np.int64)), *more], ["doc_id", "t", "number", "n_lines", "h", "pairs"][: 5 + len(more)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(make, f"doc_id {kind}, t bigint, number int, n_lines int, h bigint" + (", pairs array<bigint>" if extend else ""))


def _same(spans: DataFrame, docs: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(spans["__cut_id"]) & (F.xxhash64(docs["text"]) == spans["__cut_t"])


def _suspects(every: DataFrame) -> DataFrame:
    """Chunks whose hash occurs twice, with its number of occurrences."""
    return every.join(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("merge"), "h")


def _pieces(docs: DataFrame, suspects: DataFrame, reach: int = REACH) -> DataFrame:
    """``suspects`` with the place and bytes of each chunk, and the hashes and places of ``reach`` lines before and behind it, nearest first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["number", "n_lines", "h", "n"]

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, spans = batch.column(2), batch.column(3)
            ends = np.cumsum(spans.value_lengths().to_numpy())
            own = {c: spans.flatten().field(c).to_numpy() for c in names}
            for i in range(batch.num_rows):
                part = slice(int(ends[i - 1]) if i else 0, int(ends[i]))
                text = raw[i].as_py()
                data = np.frombuffer(text, np.uint8)
                _, begin, end, h = line_spans(data, np.zeros(1, np.int64), np.array([len(data)]))
                h = h.view(np.int64)
                low = np.maximum(own["number"][part] - reach, 0)
                high = own["number"][part] + own["n_lines"][part]
                from_, to = begin[own["number"][part]], end[high - 1]
                sides = list(zip(low.tolist(), own["number"][part].tolist(), high.tolist(), strict=True))
                lists = [[x[a:b][::-1] for a, b, _ in sides] for x in (h, begin)] + [[x[c : c + reach] for _, _, c in sides] for x in (h, end)]
                m = len(sides)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * m)), batch.column(1).take(pa.array([i] * m)), *(pa.array(own[c][part]) for c in names), *(pa.array(x.astype(np.int32)) for x in (from_, to)),
                     pa.array([text[x:y] for x, y in zip(from_.tolist(), to.tolist(), strict=True)], pa.binary()),
                     *(pa.array(x, pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True))],
                    ["doc_id", "t", *names, "begin", "end", "piece", "fore", "fore_at", "aft", "aft_at"])

    spans = suspects.groupBy(F.col("doc_id").alias("__cut_id"), F.col("t").alias("__cut_t")).agg(F.collect_list(F.struct(*names)).alias("spans"))
    raw = docs.select("doc_id", "text")
    met = raw.join(spans.hint("merge"), _same(spans, raw)).select(F.col("__cut_id").alias("doc_id"), F.col("__cut_t").alias("t"), F.col("text").cast("binary").alias("raw"), "spans")
    return met.mapInArrow(make, f"doc_id {kind}, t bigint, number int, n_lines int, h bigint, n bigint, begin int, end int, piece binary, fore array<bigint>, fore_at array<int>, aft array<bigint>, aft_at array<int>")


def _equal(a: str, b: str) -> Column:
    """How many first values of two arrays are equal."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), named_struct('n', 0, 'on', true), (s, x) -> named_struct('n', s.n + int(s.on AND x), 'on', s.on AND x), s -> s.n)")


def _repeats(docs: DataFrame, every: DataFrame, name: str, reach: int = 0) -> DataFrame:
    """``doc_id, t, number, n_lines, begin, end`` of each of ``every`` that equals an earlier one, with up to ``reach`` equal lines on either side."""
    suspects = shared.written(_suspects(every), f"{name}-suspects", compression="zstd")
    pieces = shared.written(_pieces(docs, suspects, reach), f"{name}-pieces", compression="zstd")
    spot = F.struct("doc_id", "t", "number")
    hot = F.col("n") > HOT
    stays = pieces.groupBy("h").agg(F.min_by(F.struct("doc_id", "t", "number", "piece", "fore", "aft"), spot).alias("first"), F.first("n").alias("n"))
    stays = stays.select("h", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), "first")
    dealt = pieces.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("t", "number"), F.lit(SALTS)).cast("int")).otherwise(0))
    met = dealt.join(stays.hint("merge"), ["h", "salt"]).where(F.col("piece") == F.col("first.piece"))
    itself = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    # neither the first occurrence nor one that overlaps it: a line that is three times in a row does not make the second pair a repeat of the first
    goes = met.where(~(itself & (F.col("number") < F.col("first.number") + F.col("n_lines"))))
    if reach:
        goes = goes.withColumns({"ahead": _equal("fore", "first.fore"), "behind": _equal("aft", "first.aft")})
        goes = goes.withColumns({
            "begin": F.when(F.col("ahead") > 0, F.expr("get(fore_at, ahead - 1)")).otherwise(F.col("begin")), "end": F.when(F.col("behind") > 0, F.expr("get(aft_at, behind - 1)")).otherwise(F.col("end")),
            "number": F.col("number") - F.col("ahead"), "n_lines": F.col("n_lines") + F.col("ahead") + F.col("behind"),
        })
    return goes.select("doc_id", "t", "number", "n_lines", "begin", "end")


def repeated(docs: DataFrame, extend: bool = False) -> DataFrame:
    """``doc_id, t, number, n_lines, begin, end`` of each chunk that goes with the lines around it; with ``extend``, of chunks and pairs of lines that hold every repeated pair."""
    every = shared.written(chunks(docs, extend), "chunks", compression="zstd")
    if not extend:
        return _repeats(docs, every, "chunks", REACH).distinct()
    long = shared.written(_repeats(docs, every.where("n_lines > 2").drop("pairs"), "chunks"), "long", compression="zstd")
    gone = long.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "t", "number")]).distinct().hint("merge")
    stays = every.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t") == F.col("_t")) & (F.col("number") == F.col("_number")), "left_anti")
    each = stays.select("doc_id", "t", "number", F.posexplode("pairs").alias("_at", "h"))
    pairs = each.select("doc_id", "t", (F.col("number") + F.col("_at")).alias("number"), F.lit(2).alias("n_lines"), "h")
    return long.unionByName(_repeats(docs, pairs, "pairs")).distinct()


def _merged(gone: DataFrame, kind: str) -> DataFrame:
    """``__cut_id, __cut_t, __cut_gone, __cut_lines`` from lists of spans: in order, those that overlap or touch made one, and the lines in them."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.cumsum(lists.value_lengths().to_numpy()).astype(np.int64)
            number, n, begin, end = (lists.flatten().field(c).to_numpy() for c in ("number", "n_lines", "begin", "end"))
            spans, lines = [], []
            for i in range(batch.num_rows):
                part = slice(int(ends[i - 1]) if i else 0, int(ends[i]))
                order = np.lexsort((n[part], number[part]))
                a, b = number[part][order], (number[part] + n[part])[order]
                x, y = begin[part][order], end[part][order]
                upto = np.maximum.accumulate(b)
                head = np.flatnonzero(np.append(True, a[1:] > upto[:-1]))
                last = np.append(head[1:], len(a)) - 1
                lines.append(int((upto[last] - a[head]).sum()))
                reach = np.maximum.accumulate(y)
                spans.append([{"begin": p, "end": q} for p, q in zip(x[head].tolist(), reach[last].tolist(), strict=True)])
            of = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(of)), pa.array(lines, pa.int64())], ["__cut_id", "__cut_t", "__cut_gone", "__cut_lines"])

    listed = gone.groupBy("doc_id", "t").agg(F.collect_list(F.struct("number", "n_lines", "begin", "end")).alias("spans"))
    return listed.mapInArrow(merge, f"__cut_id {kind}, __cut_t bigint, __cut_gone array<struct<begin:int,end:int>>, __cut_lines bigint")


def without(raw: Column, gone: Column) -> Column:
    """The lines of a text's bytes that are in none of the spans ``gone`` (begin, end; in order, none touches another); each piece is copied once."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["end"] + 1))
    stops = F.concat(F.transform(gone, lambda g: g["begin"] - 1), F.array(F.octet_length(raw)))
    spans = F.filter(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: x["b"] >= x["a"])
    # a line break stands before and behind each span, so that one of them is left between two pieces
    return F.array_join(F.transform(spans, lambda x: F.decode(F.substring(raw, x["a"] + 1, x["b"] - x["a"]), "UTF-8")), "\n")


def dedup(docs: DataFrame, extend: bool = False) -> DataFrame:
    """``docs`` with repeated chunks of lines taken out of the text, and ``removed_lines`` long; with ``extend``, all runs of two lines or more."""
    gone = _merged(repeated(docs, extend), docs.schema["doc_id"].dataType.simpleString())
    joined = docs.join(gone.hint("merge"), _same(gone, docs), "left")
    text = F.when(F.col("__cut_gone").isNull(), docs["text"]).otherwise(without(docs["text"].cast("binary"), F.col("__cut_gone")))
    others = [text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns if c.lower() != "removed_lines"]
    return joined.select(*others, F.coalesce("__cut_lines", F.lit(0)).cast("long").alias("removed_lines"))
