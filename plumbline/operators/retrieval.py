"""Retrieval as joins, aggregation and top-k.

Chunks (chunk_id, doc_id, text, ...) and queries (query_id, text) go in, hits
(query_id, chunk_id, score, rank) come out; ranks begin at 0.  Ties are ranked
by the score at six decimals and then by ``tie`` columns of the hits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import terms

#: Rows and bytes that are broadcast at most; beyond either the join is left to Spark.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Weights of a batch of chunks that are held as one matrix.
MATRIX = 1 << 22
#: Chunks whose terms are looked up at once.
ROWS = 512
#: Products of vectors that are held at once.
TILE = 1 << 20


def top_k(scored: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best rows of each query with rank; Spark cuts groups in the map tasks before the shuffle (WindowGroupLimit)."""
    by = [F.round("score", 6).desc(), *(F.col(c) for c in (tie or ("chunk_id",)))]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by)) - 1
    return scored.withColumn("rank", rank).where(F.col("rank") < k)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has ``rows`` rows at most, and ``most`` bytes as JSON; it stops counting there."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), size).first()
    return n <= rows and (total or 0) <= most


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf``: a term that stands twice in a query counts twice."""
    return queries.select("query_id", F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, avgdl."""
    n = F.size(terms(F.coalesce(F.col("text"), F.lit(""))))
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avgdl"))


def postings(chunks: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``term, chunk_id, tf, dl``, of the terms of ``vocabulary`` (term) alone if it is given.

    Terms are counted inside the chunk's own row, before anything is exploded
    into the shuffle, and terms that no query has never leave the map task if
    the vocabulary is small enough to be broadcast.
    """
    cut = chunks.select("chunk_id", terms(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    each = cut.select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    if vocabulary is not None:
        each = each.join(broadcast_if_small(vocabulary.select("term").distinct()), "term", "left_semi")
    return each.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def document_frequencies(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, df`` of the terms of ``vocabulary`` (term) that chunks hold: counted where the chunks lie, a row a term and task is shuffled.  Chunk ids are taken to be unique."""
    each = chunks.select(F.explode(F.array_distinct(terms(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
    return each.join(broadcast_if_small(vocabulary.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float, b: float) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = F.when(avgdl > 0, 1 - b + b * F.greatest(dl, F.lit(1)) / avgdl).otherwise(1.0)
    return idf * (tf * (k1 + 1)) / (tf + k1 * norm)


def _some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ROWS`` rows of a batch at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _places(rows: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the vocabulary and count of each row's different terms that are in it, and each row's number of terms."""
    flat = rows.flatten()
    of = np.diff(rows.offsets.to_numpy())
    found = pc.index_in(flat, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = found >= 0
    keys, count = np.unique(np.repeat(np.arange(len(rows)), of)[known] * max(len(vocabulary), 1) + found[known], return_counts=True)
    return keys // max(len(vocabulary), 1), keys % max(len(vocabulary), 1), count, of


def term_counts(chunks: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int, float]:
    """Chunks that hold each term of ``vocabulary``, chunks, and terms a chunk, in one scan; each task sends a row a term."""
    words = pa.array(vocabulary, pa.string())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(words), np.int64), 0, 0
        for part in _some(batches):
            _, term, _, size = _places(part.column(0), words)
            df += np.bincount(term, minlength=len(words))[: len(words)]
            n, total = n + len(size), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(["", " "])]), pa.array(np.append(df, [n, total]))], ["term", "n"])

    cut = chunks.select(terms(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    rows = cut.mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a query term
    sums = {r["term"]: r["n"] for r in rows}
    n, total = sums.pop("", 0) or 0, sums.pop(" ", 0) or 0
    return {t: k for t, k in sums.items() if k}, n, (total / n if n else 0.0)


def _asked(queries: DataFrame, block: int) -> Iterator[dict]:
    """Blocks of at most ``block`` queries, one at least: each one's terms with how often it has them.  Of rows with one query_id the first counts."""
    out: dict = {}
    known: set = set()
    cut = queries.select("query_id", terms(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    for r in cut.toLocalIterator():
        if r["query_id"] in known:
            continue
        known.add(r["query_id"])
        out[r["query_id"]] = Counter(r["terms"])
        if len(out) == block:
            yield out
            out = {}
    if out or not known:
        yield out


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, tie: tuple[str, ...] = ("chunk_id",), keep: tuple[str, ...] = (), block: int = 512) -> DataFrame:
    """Hits of BM25; ``keep``: further columns of the chunks that hits carry, and that may break ties.

    The queries are a stated set, taken in blocks of ``block``.  A scan counts
    the block's terms in the corpus; a second one multiplies each batch of
    chunks, as a matrix of term weights, by the block's matrix and keeps the k
    best chunks of each query, so that k rows a query leave a batch and no
    postings are shuffled.  Ties are cut by the same order as in the end.
    """
    columns = list(dict.fromkeys(["chunk_id", *tie, *keep]))
    id_type = arrow_type(queries, "query_id")
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in columns)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {kinds}, score double"
    out = None
    for asked in _asked(queries, block):
        vocabulary = sorted({t for own in asked.values() for t in own})
        df, n, avgdl = term_counts(chunks, vocabulary)
        number = {t: i for i, t in enumerate(df)}
        idf = np.array([np.log(1 + (n - f + 0.5) / (f + 0.5)) for f in df.values()])
        ids = list(asked)
        matrix = np.zeros((len(ids), len(number)))
        for q, own in enumerate(asked.values()):
            for t, c in own.items():
                if t in number:
                    matrix[q, number[t]] = c * idf[number[t]]

        def score(batches: Iterable[pa.RecordBatch], ids=ids, words=list(number), matrix=matrix, avgdl=avgdl) -> Iterator[pa.RecordBatch]:
            words = pa.array(words, pa.string())
            for whole in _some(batches):
                row, term, tf, size = _places(whole.column(len(columns)), words)
                norm = 1 - b + b * np.maximum(size, 1) / avgdl if avgdl > 0 else np.ones(len(size))
                weight = tf * (k1 + 1) / (tf + k1 * norm[row])
                # the terms of these rows alone, and as many rows as a bounded matrix holds
                lo = 0
                while lo < whole.num_rows:
                    hi = min(lo + max(MATRIX // max(len(words), 1), 64), lo + 2048, whole.num_rows)
                    i, j = np.searchsorted(row, [lo, hi])
                    some, at = np.unique(term[i:j], return_inverse=True)
                    weights = np.zeros((len(some), hi - lo))
                    weights[at, row[i:j] - lo] = weight[i:j]
                    batch = whole.slice(lo, hi - lo)
                    q, r, s = _best(matrix[:, some] @ weights, [batch.column(columns.index(c)) for c in tie], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(q)), *(batch.column(c).take(pa.array(r)) for c in range(len(columns))), pa.array(s)], ["query_id", *columns, "score"])
                    lo = hi

        part = chunks.select(*columns, terms(F.coalesce(F.col("text"), F.lit(""))).alias("_terms")).mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, *tie).select("query_id", "chunk_id", *[c for c in columns if c != "chunk_id"], "score", "rank")


def bm25_by_scope(chunks: DataFrame, queries: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, scope: str = "task_id", tie: tuple[str, ...] = ("chunk_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Hits of BM25 where chunks and queries belong to scopes, each a corpus of its own; query ids are unique over all.

    For many corpora at once: the scope is part of every key, and the plan is
    one, without a job of the driver's.  Postings of the queries' terms are
    shuffled, so that a large corpus is better searched by ``bm25`` or an index.
    """
    columns = list(dict.fromkeys(["chunk_id", *tie, *keep]))
    asked = queries.select("query_id", scope, F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("query_id", scope, "term").agg(F.count(F.lit(1)).alias("qtf"))
    cut = chunks.select(scope, *columns, terms(F.coalesce(F.col("text"), F.lit(""))).alias("_terms"))
    stats = cut.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_terms")).alias("avgdl"))
    # terms are counted within the chunk's row
    counted = F.transform(F.array_distinct("_terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("_terms", lambda x: x == t)).alias("tf")))
    posts = cut.select(scope, *columns, F.size("_terms").alias("dl"), F.explode(counted).alias("p")).select(scope, *columns, "dl", "p.term", "p.tf")
    df = posts.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, [scope, "term"]).join(stats, scope)
    met = posts.join(weighed, [scope, "term"])
    part = F.col("qtf") * bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"), k1, b)
    scored = met.select("query_id", scope, *columns, part.alias("w")).groupBy("query_id", scope, *columns).agg(F.sum("w").alias("score"))
    return top_k(scored, k, *tie).select("query_id", "chunk_id", *[c for c in columns if c != "chunk_id"], "score", "rank")


def _best(scores: np.ndarray, ties: list[pa.Array], k: int, above: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows above a limit of each query, by the score at six decimals and then by ``ties``."""
    place = np.empty(scores.shape[1], np.int64)
    place[pc.sort_indices(pa.table(ties, [str(i) for i in range(len(ties))]), sort_keys=[(str(i), "ascending") for i in range(len(ties))]).to_numpy()] = np.arange(scores.shape[1])
    rounded = np.round(scores, 6)
    if scores.shape[1] > k:
        edge = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero((rounded >= edge) & (scores > above))
    else:
        q, r = np.nonzero(scores > above)
    order = np.lexsort((place[r], -rounded[q, r], q))
    q, r = q[order], r[order]
    first = np.searchsorted(q, q)
    good = np.arange(len(q)) - first < k
    return q[good], r[good], scores[q[good], r[good]]


def _nearest(held: list[tuple[np.ndarray, pa.Array, np.ndarray]], k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The k best of each query from parts of query, chunk_id and score, in order of query, score at six decimals and chunk_id."""
    q, v = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
    chunk = pa.concat_arrays([x[1] for x in held])
    place = np.empty(len(q), np.int64)
    place[pc.sort_indices(chunk).to_numpy()] = np.arange(len(q))
    order = np.lexsort((place, -np.round(v, 6), q))
    order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
    return q[order], chunk.take(pa.array(order)), v[order]


def containing(documents: DataFrame, passages: DataFrame, block: int = 8 << 20) -> DataFrame:
    """``query_id, doc_id`` of documents in whose text a passage (query_id, text) stands; passages are a stated set, looked for all at once, in blocks of ``block`` bytes."""
    qkind, kind = (f.schema[c].dataType.simpleString() for f, c in ((passages, "query_id"), (documents, "doc_id")))
    id_type, doc_type = arrow_type(passages, "query_id"), arrow_type(documents, "doc_id")

    def blocks() -> Iterator[dict[str, list]]:
        held: dict[str, list] = {}
        size = 0
        for r in passages.where("text is not null and text <> ''").select("query_id", "text").toLocalIterator():
            held.setdefault(r["text"], []).append(r["query_id"])
            size += len(r["text"])
            if size >= block:
                yield held
                held, size = {}, 0
        yield held

    out = None
    for held in blocks():

        def look(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text, ids in held.items():
                automaton.add_word(text, ids)
            automaton.make_automaton()
            for batch in batches:
                doc, found = [], []
                for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = {i for _, ids in automaton.iter(text) for i in ids} if held and text else ()
                    doc += [d] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(found, id_type), pa.array(doc, doc_type)], ["query_id", "doc_id"])

        part = documents.select("doc_id", "text").mapInArrow(look, f"query_id {qkind}, doc_id {kind}")
        out = part if out is None else out.unionByName(part)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 50, block: int = 4096, scope: str | None = None) -> DataFrame:
    """Exact nearest vectors by dot product; with ``scope`` (a column of both) of a query's own scope alone.

    ``vectors``: chunk_id, embedding; ``queries``: query_id, embedding, a stated
    set that is taken in blocks of ``block``.  Each task multiplies some rows by
    a block at once, ``TILE`` products or one row, and keeps k for each query, so
    that a task sends k rows a query and holds a few times as many.
    """
    kind, qkind = vectors.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    out = None
    for ids, matrix, id_type, scopes in query_blocks(queries, block, scope):

        def score(batches: Iterable[pa.RecordBatch], ids=ids, matrix=matrix, id_type=id_type, scopes=scopes) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
            edge, own = np.full(len(ids), -np.inf), np.array(scopes, object)
            # rows whose products with the block are held at once
            step = max(TILE // max(len(ids), 1), 1)
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    batch = whole.slice(lo, step)
                    e = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    e = e.reshape(batch.num_rows, -1)
                    s = matrix @ e.T if matrix.size else np.zeros((len(ids), batch.num_rows))
                    if scope:
                        s[own[:, None] != np.array(batch.column(2).to_pylist(), object)[None, :]] = -np.inf
                    q, r, v = _best(s, [batch.column(0)], k, -np.inf)
                    near = np.round(v, 6) >= edge[q]
                    held.append((q[near], batch.column(0).take(pa.array(r[near])), v[near]))
                    if sum(len(x[0]) for x in held) > max(TILE, 2 * len(ids) * k):
                        held = [_nearest(held, k)]
                        full = np.bincount(held[0][0], minlength=len(ids)) == k
                        edge[full] = np.round(held[0][2][np.cumsum(np.bincount(held[0][0], minlength=len(ids)))[full] - 1], 6)
            if held:
                q, chunk, v = _nearest(held, k)
                for lo in range(0, len(q), 10_000):
                    some = slice(lo, lo + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(q[some])), chunk[some], pa.array(v[some])], ["query_id", "chunk_id", "score"])

        part = vectors.where("chunk_id is not null and embedding is not null").select("chunk_id", "embedding", *([scope] if scope else [])).mapInArrow(score, f"query_id {qkind}, chunk_id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k)


def query_blocks(queries: DataFrame, block: int, scope: str | None = None) -> Iterator[tuple[list, np.ndarray, pa.DataType, list]]:
    """Ids, vectors and scopes of at most ``block`` queries, one block at least."""
    ids, rows, scopes, some = [], [], [], False
    id_type = arrow_type(queries, "query_id")
    for r in queries.where("embedding is not null").select("query_id", "embedding", *([scope] if scope else [])).toLocalIterator():
        ids.append(r["query_id"])
        rows.append(r["embedding"])
        scopes.append(r[scope] if scope else None)
        if len(ids) == block:
            yield ids, np.array(rows, np.float64), id_type, scopes
            ids, rows, scopes, some = [], [], [], True
    if ids or not some:
        yield ids, np.array(rows, np.float64).reshape(len(ids), -1), id_type, scopes


def embed(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", normalize: bool = True, batch: int = 32) -> DataFrame:
    """``rows`` with an embedding column, by an encoder of lists of texts that is loaded once a worker."""
    from pyspark.sql import types as T

    names = [*rows.columns, "embedding"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            parts = [np.asarray(encoder(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            m = np.concatenate(parts) if parts else np.empty((0, 0), np.float32)
            if normalize and m.size:
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.size else 0)), pa.array(m.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names)

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return rows.select("*", F.col(text).alias("__text")).mapInArrow(run, schema)


def rrf(rankings: list[DataFrame], k: int = 50, rrf_k: int = 60, tie: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Reciprocal-rank fusion of hits (query_id, chunk_id, rank)."""
    each = [r.select("query_id", "chunk_id", (1.0 / (F.col("rank") + (rrf_k + 1))).alias("s")) for r in rankings]
    both = each[0]
    for r in each[1:]:
        both = both.unionByName(r)
    return top_k(both.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score")), k, *tie)


def oversample(k: int, own: int) -> int:
    """How many hits each ranking is asked for before fusion."""
    return max(3 * k, own)
