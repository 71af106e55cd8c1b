"""Chunkers: documents (doc_id, text) to chunks (chunk_id, doc_id, text, position).

Each is a Column expression that makes an array of chunk texts, exploded with
its position: no shuffle, and other columns of the documents are inherited.
A null text is an empty one, and an empty text has no chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T

#: Separators from the coarsest to single characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def check_overlap(size: int, overlap: int) -> None:
    """Sizes are 1 at least, and an overlap is smaller than its size."""
    if size < 1 or overlap < 0:
        raise ValueError(f"size must be at least 1 and overlap at least 0, not {size} and {overlap}")
    if overlap >= size:
        raise ValueError(f"overlap {overlap} must be smaller than size {size}")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _cut(text: Column, separators: Sequence[str], size: int) -> Column:
    """Pieces of one text by the first separator; pieces that are too long are cut by the others."""
    if not separators:
        return F.array(text)
    sep, rest = separators[0], separators[1:]
    if sep == "":
        starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
        return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), lambda p: p != "")

    def cut(parts: Column) -> Column:
        # all but the last part end with the separator; an empty part goes, and its separator with it
        marked = F.transform(parts, lambda p, i: F.when(p == "", "").when(i < F.size(parts) - 1, F.concat(p, F.lit(sep))).otherwise(p))
        pieces = F.filter(marked, lambda p: p != "")
        return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_cut(p, rest, size))))

    # as a lambda's variable the parts are made once, and not for each part
    return F.flatten(F.transform(F.array(F.split(text, rf"\Q{sep}\E", -1)), cut))


def recursive_chunks(text: Column, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> Column:
    """Pieces put together while they fit into ``size``; the next chunk begins with the last ``overlap`` characters of the one before."""
    check_overlap(size, overlap)
    start = F.struct(_strings().alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(p) <= size
        tail = F.substring(acc["buf"], F.greatest(F.lit(1), F.length(acc["buf"]) - (overlap - 1)), F.lit(overlap)) if overlap else F.lit("")
        return F.when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["buf"], p).alias("buf"))).otherwise(
            F.struct(F.when(acc["buf"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["buf"])).alias("out"), F.concat(tail, p).alias("buf")))

    pieces = F.when(F.length(text) <= size, F.filter(F.array(text), lambda p: p != "")).otherwise(_cut(text, tuple(separators), size))
    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["buf"])))


def fixed_chunks(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Windows of ``size`` tokens that begin every ``size - overlap`` tokens, joined by single spaces."""
    check_overlap(size, overlap)

    def windows(tok: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(tok), F.lit(size - overlap))
        return F.when(F.size(tok) > 0, F.transform(starts, lambda i: F.array_join(F.slice(tok, i, F.lit(size)), " "))).otherwise(_strings())

    # as a lambda's variable the tokens are made once for all windows
    return F.flatten(F.transform(F.array(T.tokens(text)), windows))


def sentence_chunks(text: Column, size: int = 800, overlap: int = 1) -> Column:
    """Sentences packed into chunks of ``size`` characters; the last ``overlap`` sentences begin the next chunk.

    Sentences carried over are dropped from the front until the next one fits,
    so every chunk takes in a new sentence; one that is too long stands alone.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be at least 1 and overlap at least 0")
    start = F.struct(_strings().alias("out"), _strings().alias("held"))

    def fits(held: Column, s: Column) -> Column:
        return (F.size(held) == 0) | (F.length(F.array_join(held, " ")) + F.length(s) + 1 <= size)

    def step(acc: Column, s: Column) -> Column:
        held = acc["held"]
        # the longest tail of the last ``overlap`` sentences with which s fits
        tails = [F.slice(held, F.greatest(F.lit(1), F.size(held) - (k - 1)), F.lit(k)) for k in range(overlap, 0, -1)]
        carry = F.coalesce(*[F.when((F.size(held) >= k) & fits(t, s), t) for k, t in zip(range(overlap, 0, -1), tails, strict=True)], _strings())
        return F.when(fits(held, s), F.struct(acc["out"].alias("out"), F.array_append(held, s).alias("held"))).otherwise(
            F.struct(F.array_append(acc["out"], F.array_join(held, " ")).alias("out"), F.array_append(carry, s).alias("held")))

    return F.aggregate(
        T.sentences(text), start, step, lambda acc: F.when(F.size(acc["held"]) > 0, F.array_append(acc["out"], F.array_join(acc["held"], " "))).otherwise(acc["out"]))


def explode_chunks(documents: DataFrame, pieces: Column) -> DataFrame:
    """One row for each chunk, in order of position; further columns are inherited."""
    inherited = [c for c in documents.columns if c not in ("doc_id", "text", "chunk_id", "position")]
    rows = documents.select("doc_id", *inherited, F.posexplode(pieces).alias("position", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("position")).alias("chunk_id"), "doc_id", "text", "position", *inherited)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def chunk_recursive(documents: DataFrame, chunk_size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    return explode_chunks(documents, recursive_chunks(_text(), chunk_size, overlap, separators))


def chunk_fixed(documents: DataFrame, chunk_size: int = 200, overlap: int = 40) -> DataFrame:
    return explode_chunks(documents, fixed_chunks(_text(), chunk_size, overlap))


def chunk_sentence(documents: DataFrame, chunk_size: int = 800, overlap_sentences: int = 1) -> DataFrame:
    return explode_chunks(documents, sentence_chunks(_text(), chunk_size, overlap_sentences))


def claims(answers: DataFrame, text: str = "text") -> DataFrame:
    """``answers`` with claim_idx and claim, one row for each atomic claim."""
    return answers.select("*", F.posexplode(T.atomic_claims(F.coalesce(F.col(text), F.lit("")))).alias("claim_idx", "claim"))
