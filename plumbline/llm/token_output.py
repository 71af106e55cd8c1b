"""Token ids as Parquet list columns, and reading them back selectively.

Layout of one output folder:

``tokens/``  one file for each range of doc_ids, rows in ascending order:
    doc_id, part (number of the range), local_start (ids of the part before the
    document), n_tokens, ids (list of 32-bit integers).
``parts/``   part, first_start (ids of all parts before it), n_tokens, n_rows.

Ids are dictionary encoded (most of a text's ids are few frequent ones); the
integer columns are delta encoded by the version 2 writer, since they rise
within a part.  Row groups and pages are bounded, and the writer adds column
and offset indexes, so that a reader of a few documents or of the metadata
alone fetches only their pages.

Defined cases: a null text is the empty one and yields the end id alone; rows
that share a doc_id are all written, by their texts' order; a null doc_id
comes before all others; a table without rows yields empty files; other
columns are not written.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm import words as W
from plumbline.llm.vocabulary import drops_space, load, vocabulary_path

END_ID = 2
#: A Python worker remembers half of 2**this many distinct chunks at most.
INDEX_BITS = 20
#: Chunks that the library gets in one call.
TOGETHER = 256
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}
#: Ids that one part is to hold, about; parts are ranges of doc_id.
PART_BYTES = 48 << 20


class Ids:
    """Ragged ids of a list of chunks."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.begin = np.cumsum(lengths) - lengths

    def __add__(self, other: "Ids") -> "Ids":
        return Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.lengths, other.lengths]))

    def kept(self, which: np.ndarray) -> "Ids":
        return Ids(*self.take(which))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks ``which`` one after the other, and how many each has."""
        n = self.lengths[which]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[which] - (ends - n), n)], n


class Encoder:
    """Ids of texts by the tokenizers library.

    Where the file drops white space, a text's ids are those of its chunks
    between ASCII white space one after the other, and the library is asked
    once for each distinct chunk that is remembered.
    """

    def __init__(self, path: str, bits: int = INDEX_BITS):
        self.tokenizer = load(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks = W.Remembered(self._learn, bits) if drops_space(path) else None

    def _library(self, texts: list[str]) -> Ids:
        ids = [e.ids for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return Ids(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths)

    def _learn(self, chunks: list[bytes]) -> Ids:
        """Chunks go to the library ``TOGETHER`` at a time with a space between; offsets tell whose each id is."""
        flat: list[int] = []
        lengths = [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), TOGETHER):
            part = [c.decode() for c in chunks[i : i + TOGETHER]]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            at = np.fromiter((x for x, _ in got.offsets), np.int64, len(got))
            lengths.append(np.bincount(np.searchsorted(np.cumsum(sizes), at, "right"), minlength=len(part)))
            flat += got.ids
        return Ids(np.array(flat, np.int32), np.concatenate(lengths))

    def encode(self, column: pa.Array, end_id: int | None = None) -> Ids:
        """The ids of each text of a string column, with ``end_id`` after each."""
        if self.chunks is None:
            out = self._library([t or "" for t in column.to_pylist()])
        else:
            words = W.Words(*W.buffers(column))
            numbers = self.chunks.numbers(words)
            flat, n = self.chunks.store.take(numbers)
            ends = np.concatenate([[0], np.cumsum(n)])
            out = Ids(flat, ends[words.of[1:]] - ends[words.of[:-1]])
        if end_id is None:
            return out
        return Ids(np.insert(out.flat, np.cumsum(out.lengths), np.int32(end_id)), out.lengths + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, i = np.cumsum(sizes), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, parts: int | None = None) -> str:
    """Write the ids of ``docs`` (doc_id, text) below ``path``, in ascending doc_id order, and return ``path``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids = own.encode(batch.column(1)[i:j], end_id)
                counts, ends = ids.lengths, np.cumsum(ids.lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(np.full(j - i, part, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1]) if len(ends) else 0
            W.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = ordered.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, part int, local_start bigint, n_tokens bigint, ids array<int>")
    rows.write.options(**WRITER).parquet(f"{path}/tokens")
    sums = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
    # one row a part: as many as there are tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_start"), "n_tokens", "n_rows").coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Documents of an output folder; only the pages of ``columns`` are read."""
    rows, parts = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/parts").select("part", "first_start")
    if "start" in columns:
        rows = rows.join(parts, "part").withColumn("start", F.col("first_start") + F.col("local_start"))
    return rows.select(*columns)


def with_crc(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """``rows`` with ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, in place of the ids."""
    names = [c for c in rows.columns if c != ids]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            at = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).view(np.uint8))
            crc = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], crc], [*names, "ids_crc32"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != ids)
    return rows.select(*names, ids).mapInArrow(sums, f"{kinds}, ids_crc32 bigint")


def encode_and_read(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, read from files written for ``docs`` in the shared folder."""
    spark = docs.sparkSession
    path = write_tokens(docs, shared.new_path(spark, "tokens"), **options)
    return with_crc(read_tokens(spark, path))
