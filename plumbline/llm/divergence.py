"""How the sources of each language differ in their use of words, exactly, from sparse counts.

Counts of (lang, source, term) are added up within tasks, then by term.  A
language keeps the terms of enough of its documents; every group's smoothed
share of a kept term is an integer in billionths.

Pairs of sources.  A term that a source lacks has that source's base share, so
the sum over all kept terms of two sources' absolute differences is the
difference of their base shares for every term, plus what each source's own
terms add to that against the other's base share, corrected where both have a
term.  The first needs one row a source, the second one row for each distinct
share of a source and each other source, and only the correction joins terms.

Terms above their language's share are ranked by radix selection: histograms
over ten bits of the value at a time, counted where the rows lie, lead to each
group's k-th value; among the rows of that value, histograms over UTF-8
prefixes of doubling length lead to the last item taken.  Only then are rows
put in order, about k a group.

Defined cases: null text, lang and source are the empty string; texts of any
length are read whole; repeated rows count one by one; a group without terms
has pairs of value by base shares alone (0 where its language keeps no term)
and no term rows; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import runs as R
from plumbline.llm import shared
from plumbline.llm import words as W

MIN_DOCUMENTS = 30
TOP = 50
#: Added to every count, and the whole that shares are parts of.
SMOOTHING = 5
SCALE = 1_000_000_000
#: Values have at most so many bits; a histogram is over DIGIT of them.
BITS, DIGIT = 30, 10
#: Rows of one value and prefix that are put in order without a further histogram.
ORDERED = 4096
#: Groups whose thresholds are sent to all tasks; beyond it they are joined by key.
SENT = 50_000
#: A task holds half of 2**this many (group, term) at most before it hands their counts on.
INDEX_BITS = 20


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, docs, n``: partial counts, and for each group rows of the term '' with its documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = R.Counter(2, INDEX_BITS)
        known: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []

        def out(groups: np.ndarray, found: pa.Array, docs_: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            lang, source = (pa.array([g[k] for g in names], pa.string()).take(pa.array(groups)) for k in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, found.cast(pa.string()), pa.array(docs_), pa.array(n)], ["lang", "source", "term", "docs", "n"])

        for batch in batches:
            pairs = [(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            for p in pairs:
                if p not in known:
                    known[p] = len(names)
                    names.append(p)
            group = np.array([known[p] for p in pairs], np.int64)
            rows = np.bincount(group, minlength=len(names))
            here = np.flatnonzero(rows)
            yield out(here, pa.array([""] * len(here), pa.large_string()), rows[here].astype(np.int64), np.zeros(len(here), np.int64))
            for first, own in R.blocks(batch.column(0), R.terms):
                if not len(own.begin):
                    continue
                h = own.hashes()
                row = own.rows()
                _, which, n = np.unique(W.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                of = group[row[which] + first]
                tell = W.mix(h[which] ^ W.mix(of.astype(np.uint64) + np.uint64(1)))
                for g, found, sums in held.add(own, which, tell, of, [np.ones(len(which)), n]):
                    yield out(g, found, sums[0], sums[1])
        for g, found, sums in held.rest():
            yield out(g, found, sums[0], sums[1])
        W.give_back()

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, docs bigint, n bigint")


def share(count: str, total: str, terms: str) -> F.Column:
    """The smoothed share of a count in billionths, from 1."""
    return F.expr(f"1 + (CAST({count} + {SMOOTHING} AS DECIMAL(28, 0)) * {SCALE}) div CAST(greatest({total} + {SMOOTHING} * {terms}, 1) AS DECIMAL(28, 0))")


def sparse_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n, lang_n, head``: kept terms' counts in each group that has them and in the language, and a row of the term '' for each group.

    ``head`` marks one row a language and term.
    """
    whole = Window.partitionBy("lang", "term")
    summed = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    known = summed.withColumns({"in_docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "head": F.col("source") == F.min("source").over(whole)})
    return known.where((F.col("term") == "") | (F.col("in_docs") >= min_documents)).select("lang", "source", "term", "n", "lang_n", "head")


def _sent(rows: DataFrame) -> DataFrame:
    """Rows for each group, broadcast where they have been counted to be few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def top(rows: DataFrame, keys: Sequence[str], value: str, item: str, k: int, bits: int = BITS, digit: int = DIGIT, ordered: int = ORDERED) -> DataFrame:
    """The k rows of each group of the largest values, ties by UTF-8 bytes of the item; with ``rank`` from 1.

    Values are whole, from 0 to 2**bits; a group's items are distinct.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys)

    def narrowed(hist: DataFrame, order: F.Column, first: DataFrame | None) -> DataFrame:
        """For each group: the bucket in which the last row lies, the rows still wanted of it, and how many it has."""
        got = hist.withColumn("upto", F.sum("count").over(by.orderBy(order)))
        got = got.withColumn("need", F.lit(k)) if first is None else got.join(_sent(first.select(*keys, "need")), keys)
        all_of = F.max("upto").over(by) <= F.col("need")
        last = F.when(all_of, F.row_number().over(by.orderBy(order)) == F.count("*").over(by)).otherwise((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need")))
        return got.withColumn("last", last).where("last").select(*keys, "bucket", (F.col("need") - F.col("upto") + F.col("count")).alias("need"), "count")

    at = None
    for shift in range(bits - digit, -1, -digit):
        own = rows.select(*keys, F.shiftright(value, shift).alias("bucket"))
        if at is not None:
            above = _sent(at.select(*keys, F.col("bucket").alias("above")))
            own = own.join(above, keys).where(F.shiftright("bucket", digit) == F.col("above")).drop("above")
        at = shared.checkpointed(narrowed(own.groupBy(*keys, "bucket").count(), F.desc("bucket"), at))
    limit = at.select(*keys, F.col("bucket").alias("least"), "need", "count")
    # among ties: the bytes up to which items are taken
    raw = F.col(item).cast("binary")
    ties = limit.select(*keys, "least", "need", "count", F.lit(b"").alias("upto_bytes"))
    size = 2
    while not (left := ties.where((F.col("count") > ordered) & (F.col("count") > F.col("need")))).isEmpty():
        open_ = _sent(shared.checkpointed(left))
        size *= 2
        same = rows.join(open_, keys).where((F.col(value) == F.col("least")) & (F.substring(raw, 1, size // 2 if size > 4 else 0) == F.col("upto_bytes")))
        hist = same.groupBy(*keys, F.substring(raw, 1, size).alias("bucket")).count()
        found = narrowed(hist, F.asc("bucket"), left).withColumnsRenamed({"bucket": "b", "need": "n_", "count": "c"})
        ties = shared.checkpointed(
            ties.join(found, keys, "left").select(*keys, "least", F.coalesce("n_", "need").alias("need"), F.coalesce("c", "count").alias("count"), F.coalesce("b", "upto_bytes").alias("upto_bytes"))
        )
    edge = _sent(ties.select(*keys, "least", "upto_bytes"))
    upto = F.length("upto_bytes")
    inside = (F.col(value) > F.col("least")) | (F.col(value) == F.col("least")) & ((upto == 0) | (F.expr(f"substring(CAST({item} AS BINARY), 1, length(upto_bytes))") <= F.col("upto_bytes")))
    few = rows.join(edge, keys).where(inside).drop("least", "upto_bytes")
    return few.withColumn("rank", F.row_number().over(by.orderBy(F.desc(value), F.asc(item)))).where(F.col("rank") <= k)


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, k: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` from ``docs`` (text, lang, source).

    Part ``pair``: the other sources of the language by their distance; part
    ``term``: the kept terms of which the group has most more than its language.
    """
    sparse = shared.written(sparse_counts(docs, min_documents), "terms")
    kept = sparse.where("term <> ''")
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    groups = sparse.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "size", "terms", "lang_total"])
    groups = shared.checkpointed(groups.withColumn("base", share("0", "total", "terms")))
    shares = kept.join(_sent(groups.select("lang", "source", "total", "terms", "lang_total", "base")), ["lang", "source"])
    shares = shared.written(shares.select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"), "base"), "shares")

    # distances of unordered pairs, from base shares, from each source's own terms, and from terms of both
    one, two = groups.select("lang", F.col("source").alias("a"), "terms", F.col("size").alias("size_a"), F.col("base").alias("base_a")), groups.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"), F.col("base").alias("base_b"))
    bases = one.join(two, "lang").where("a < b").select("lang", "a", "b", F.expr("(terms - size_a - size_b) * abs(base_a - base_b)").alias("v"))
    flat = shares.groupBy("lang", "source", "p").count().join(_sent(groups.select("lang", F.col("source").alias("other"), F.col("base").alias("of_other"))), "lang").where("source <> other")
    alone = flat.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.expr("count * abs(p - of_other)").alias("v"))
    x, y = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("base").alias("base_a")), shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("base").alias("base_b"))
    both = x.join(y, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr("abs(p_a - p_b) - abs(p_a - base_b) - abs(p_b - base_a) + abs(base_a - base_b)").alias("v"))
    # each part is added up on its own first, where its rows lie
    pairs = None
    for part in (bases, alone, both):
        part = part.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))  # a row for each other source

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = top(above, ["lang", "source"], "value", "item", k)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(names).unionByName(terms.withColumn("part", F.lit("term")).select(names))
