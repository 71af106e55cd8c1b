"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie one after the other in one array of symbols.  In a
round each sequence finds its lowest-ranked adjacent pair, and every sequence
applies its own at once, at each place from left to right; rounds go on until
no sequence has a pair with a rank.  What is left of a sequence are its tokens.

Cutting into pre-tokens and normalisation are the tokenizer file's own; the
merges are ours.  Distinct chunks between ASCII white space are counted once
for each worker and remembered.

Defined cases: a null text is the empty one, with 0 bytes and 0 tokens;
repeated rows are counted one by one; a table without rows gives none; only
doc_id and the text are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import words as W
from plumbline.llm.token_output import slices
from plumbline.llm.vocabulary import drops_space, load, vocabulary_path

LIMIT = 2048
#: A Python worker remembers half of 2**this many distinct chunks at most.
INDEX_BITS = 21
#: Chunks that are merged at once.
AT_ONCE = 32768


class Merger:
    """Counts the tokens of chunks of text as the tokenizer file at ``path`` gives them."""

    def __init__(self, path: str, bits: int = INDEX_BITS):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path} is not a BPE file")
        if model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path} uses options of BPE that are not supported here")
        tokenizer = load(path)
        self.normalizer, self.pre = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        size = max(self.vocab.values()) + 1
        self.size = size
        left, right, to = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(self.vocab[a])
            right.append(self.vocab[b])
            to.append(self.vocab[a + b])
        keys = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.to = keys[order], order.astype(np.int64), np.array(to, np.int64)
        if not drops_space(path):
            raise ValueError(f"white space is part of pre-tokens in {path}")
        # ids of single characters inside a pre-token and at its end
        points = max(ord(s[0]) for s in self.vocab if len(s.removesuffix(self.suffix)) == 1) + 1
        self.middle = np.array([self.vocab.get(chr(c), -1) for c in range(points)], np.int64)
        self.final = np.array([self.vocab.get(chr(c) + self.suffix, -1) for c in range(points)], np.int64)
        self.chunks = W.Remembered(self._learn, bits)

    def _ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol; a large number where there is none."""
        none = np.int64(1 << 40)
        out = np.full(len(symbols), none)
        if len(symbols) > 1:
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            out[:-1] = np.where((self.keys[at] == pair) & ~last[:-1], self.rank[at], none)
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols are left of each sequence when no pair has a rank."""
        done = lengths.copy()
        which = np.flatnonzero(lengths > 1)
        if len(which) < len(lengths):
            symbols = symbols[np.repeat(lengths > 1, lengths)]
            lengths = lengths[which]
        while len(which):
            begin = np.cumsum(lengths) - lengths
            last = np.zeros(len(symbols), bool)
            last[begin + lengths - 1] = True
            rank = self._ranks(symbols, last)
            lowest = np.minimum.reduceat(rank, begin)
            active = lowest < (1 << 40)
            if not active.all():
                # sequences without a pair are finished
                done[which[~active]] = lengths[~active]
                keep = np.repeat(active, lengths)
                symbols, rank, lowest = symbols[keep], rank[keep], lowest[active]
                which, lengths = which[active], lengths[active]
                if not len(which):
                    break
            hit = rank == np.repeat(lowest, lengths)
            if (over := hit[1:] & hit[:-1]).any():
                # runs such as a a a: every second place of a run, from its left
                runs = np.flatnonzero(hit)
                head = np.concatenate([[True], np.diff(runs) > 1])
                place = np.arange(len(runs)) - np.maximum.accumulate(np.where(head, np.arange(len(runs)), 0))
                hit[runs[place % 2 == 1]] = False
            del over
            symbols = symbols.copy()
            symbols[hit] = self.to[np.repeat(lowest, lengths)[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[1:] = hit[:-1]
            lengths = lengths - np.add.reduceat(gone, np.cumsum(lengths) - lengths)
            symbols = symbols[~gone]
        return done

    def _slow(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of one chunk, and the special tokens in it."""
        parts, found = [chunk], 0
        for special in self.specials:
            split = [p.split(special) for p in parts]
            found += sum(len(s) - 1 for s in split)
            parts = [x for s in split for x in s]
        out: list[str] = []
        for part in filter(None, parts):
            text = self.normalizer.normalize_str(part) if self.normalizer else part
            out += [p for p, _ in self.pre.pre_tokenize_str(text)] if self.pre else [text]
        return out, found

    def pieces(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pre-tokens of chunks without ASCII white space, each one's chunk, and the special tokens of each chunk.

        Chunks go through the file's normaliser and pre-tokenizer together,
        with a space between each other; where the spaces that come out are not
        those that went in, and where special tokens occur, one by one.
        """
        extra = np.zeros(len(chunks), np.int64)
        alone = [k for k, c in enumerate(chunks) if any(s in c for s in self.specials) or not c.isascii() and len(c.split()) != 1]
        easy = np.ones(len(chunks), bool)
        easy[alone] = False
        at = np.flatnonzero(easy)
        text = " ".join(chunks[k] for k in at.tolist())
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
        out: list[str] = []
        of = np.empty(0, np.int64)
        if len(spaces) == max(len(at) - 1, 0) and self.pre:
            cut = self.pre.pre_tokenize_str(text)
            out = [p for p, _ in cut]
            of = at[np.searchsorted(spaces, np.fromiter((s for _, (s, _) in cut), np.int64, len(cut)))] if cut else of
        else:
            alone = list(range(len(chunks)))
        more: list[int] = []
        for k in alone:
            own, extra[k] = self._slow(chunks[k])
            out += own
            more += [k] * len(own)
        return out, np.concatenate([of, np.array(more, np.int64)]), extra

    def counts(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of each chunk."""
        if not chunks:
            return np.zeros(0, np.int64)
        pieces, of, extra = self.pieces([c.decode() for c in chunks])
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        if len(points) and points.max() >= len(self.middle):
            raise ValueError("the pre-tokenizer is not a byte-level one")
        symbols = self.middle[points]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[points[ends]]
        if (gone := symbols < 0).any():  # the file has no unknown token, so such a symbol yields nothing
            lengths = lengths - np.bincount(np.repeat(np.arange(len(lengths)), lengths)[gone], minlength=len(lengths))
            symbols = symbols[~gone]
        left = self.merge(symbols, lengths)
        return extra + np.bincount(of, left, minlength=len(chunks)).astype(np.int64)

    def _learn(self, chunks: list[bytes]) -> "Counts":
        return Counts(np.concatenate([np.zeros(0, np.int64), *(self.counts(chunks[i : i + AT_ONCE]) for i in range(0, len(chunks), AT_ONCE))]))

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column."""
        words = W.Words(*W.buffers(column))
        numbers = self.chunks.numbers(words)
        sums = np.concatenate([[0], np.cumsum(self.chunks.store.n[numbers])])
        return sums[words.of[1:]] - sums[words.of[:-1]]


class Counts:
    """Token counts of a list of chunks."""

    def __init__(self, n: np.ndarray):
        self.n = n

    def __add__(self, other: "Counts") -> "Counts":
        return Counts(np.concatenate([self.n, other.n]))

    def kept(self, which: np.ndarray) -> "Counts":
        return Counts(self.n[which])


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One merger for each worker process and file."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs`` (doc_id, text)."""
    vocabulary = vocabulary or vocabulary_path()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary)
        for batch in batches:
            _, first, last = W.buffers(batch.column(1))
            n = np.concatenate([np.zeros(0, np.int64), *(own.count(batch.column(1)[i:j]) for i, j in slices(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last - first), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
