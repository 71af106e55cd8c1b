"""Queries of the engine's operators over the tables of a folder, each with the SQL that says the same.

Benchmark texts are the queries of a retrieval task whose corpus is
``documents``; a document is gold for an item if it contains the item's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.partitions import numbered, spread
from plumbline.operators import chunkers, generate, index, leaderboard, metrics, repro, rerank, retrieval, rouge, stats
from plumbline.sources import submissions, tasks
from plumbline.sources.scratch import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def halves_up(c: str, digits: int):
    """A double rounded as the SQL does it, by its product with a power of ten; ``F.round`` goes by its decimal form, which may lie on the other side of a half."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


# SQL parts

_WS = r"[\s\x{1c}-\x{1f}\x{85}\pZ]"
_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda t: t <> '')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _answer(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '{_PUNCT}', ' ', 'g'), '{_WS}+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def _norm(x: str) -> str:
    return f"array_to_string({_answer(x)}, ' ')"


def _terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[A-Za-z0-9]+(?:''[a-z]+)?')"


def _f1(p: str, g: str) -> str:
    common = f"coalesce(list_sum(list_transform(list_distinct(list_intersect({p}, {g})), lambda t: least(len(list_filter({p}, lambda y: y = t)), len(list_filter({g}, lambda y: y = t))))), 0)"
    return f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 THEN 0.0 ELSE 2.0 * {common} / (len({p}) + len({g})) END"


_FIXED = f"""docs_t AS (SELECT doc_id, {_tokens("coalesce(text, '')")} AS tok FROM documents),
chunks AS (
  SELECT doc_id || '#' || p AS chunk_id, doc_id, CAST(p AS INTEGER) AS position, array_to_string(tok[p * 160 + 1 : p * 160 + 200], ' ') AS text
  FROM (SELECT doc_id, tok, unnest(range(0, CAST(ceil(len(tok) / 160.0) AS BIGINT))) AS p FROM docs_t WHERE len(tok) > 0)
)"""

_BM25 = f"""{_FIXED},
ct AS (SELECT chunk_id, {_terms("text")} AS t FROM chunks),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ct),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM ct) WHERE term IN (SELECT term FROM qt) GROUP BY term, chunk_id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (
  SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (CASE WHEN avgdl > 0 THEN 0.25 + 0.75 * greatest(dl, 1) / avgdl ELSE 1 END))) AS score
  FROM post JOIN qt USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY query_id, chunk_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) - 1 AS rank FROM sc),
hits AS (
  SELECT r.query_id, r.chunk_id, r.score, CAST(r.rank AS INTEGER) AS rank, c.doc_id, c.text, b.text AS query_text
  FROM ranked r JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = r.query_id WHERE r.rank < 10
)"""

_OVERLAP = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x)))"


def _jaccard(a: str, b: str) -> str:
    a, b = _OVERLAP.format(a), _OVERLAP.format(b)
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) * 1.0 / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


_RERANK = f"""{_BM25},
jac AS (SELECT *, {_jaccard("query_text", "text")} AS jac FROM hits),
reranked AS (SELECT query_id, chunk_id, doc_id, text, jac AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY jac DESC, rank) - 1 AS INTEGER) AS rank FROM jac)"""

_GOLDS = "golds AS (SELECT b.item_id AS query_id, list(CAST(d.doc_id AS VARCHAR) ORDER BY CAST(d.doc_id AS VARCHAR)) AS gold_passages FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"


# Chunkers


@query(f"WITH {_FIXED} SELECT chunk_id, doc_id, position, text FROM chunks")
def chunk_fixed(spark, sf_dir):
    return chunkers.chunk_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _cut_sql(x: str, separators: tuple[str, ...], size: int, depth: int = 0) -> str:
    if not separators:
        return f"[{x}]"
    sep, rest = separators[0].replace("\n", "' || chr(10) || '"), separators[1:]
    p = f"p{depth}"
    if separators[0] == "":
        return f"list_transform(range(1, length({x}) + 1, {size}), lambda {p}: substring({x}, {p}, {size}))"
    parts = f"string_split({x}, '{sep}')"
    marked = f"list_transform({parts}, lambda {p}, i{depth}: CASE WHEN {p} = '' THEN '' WHEN i{depth} < len({parts}) THEN {p} || '{sep}' ELSE {p} END)"
    return f"flatten(list_transform(list_filter({marked}, lambda {p}: {p} <> ''), lambda {p}: CASE WHEN length({p}) <= {size} THEN [{p}] ELSE {_cut_sql(p, rest, size, depth + 1)} END))"


_EXPLODED = "SELECT doc_id || '#' || (i - 1) AS chunk_id, doc_id, CAST(i - 1 AS INTEGER) AS position, o[i] AS text FROM (SELECT doc_id, o, unnest(range(1, len(o) + 1)) AS i FROM done)"


@query(f"""WITH pieces AS (
  SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN CAST([] AS VARCHAR[]) WHEN length(text) <= 1000 THEN [text] ELSE {_cut_sql("text", chunkers.SEPARATORS, 1000)} END AS p FROM documents
), folded AS (
  SELECT doc_id, list_reduce(list_prepend({{'o': CAST([] AS VARCHAR[]), 'b': ''}}, list_transform(p, lambda x: {{'o': CAST([] AS VARCHAR[]), 'b': x}})),
    lambda a, e: CASE WHEN length(a.b) + length(e.b) <= 1000 THEN {{'o': a.o, 'b': a.b || e.b}} ELSE {{'o': CASE WHEN a.b = '' THEN a.o ELSE list_append(a.o, a.b) END, 'b': right(a.b, 200) || e.b}} END) AS s
  FROM pieces
), done AS (SELECT doc_id, CASE WHEN s.b = '' THEN s.o ELSE list_append(s.o, s.b) END AS o FROM folded) {_EXPLODED}""")
def chunk_recursive(spark, sf_dir):
    return chunkers.chunk_recursive(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sentences(x: str) -> str:
    cut = rf"""string_split(regexp_replace({x}, '([.!?]){_WS}+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
    return f"list_filter(list_transform({cut}, lambda s: {_trim('s')}), lambda s: s <> '')"


@query(f"""WITH sents AS (SELECT doc_id, {_sentences("coalesce(text, '')")} AS p FROM documents),
folded AS (
  SELECT doc_id, list_reduce(list_prepend({{'o': CAST([] AS VARCHAR[]), 'h': CAST([] AS VARCHAR[])}}, list_transform(p, lambda x: {{'o': CAST([] AS VARCHAR[]), 'h': [x]}})),
    lambda a, e: CASE WHEN len(a.h) = 0 OR length(array_to_string(a.h, ' ')) + length(e.h[1]) + 1 <= 800 THEN {{'o': a.o, 'h': list_append(a.h, e.h[1])}}
      WHEN length(a.h[-1]) + length(e.h[1]) + 1 <= 800 THEN {{'o': list_append(a.o, array_to_string(a.h, ' ')), 'h': [a.h[-1], e.h[1]]}}
      ELSE {{'o': list_append(a.o, array_to_string(a.h, ' ')), 'h': [e.h[1]]}} END) AS s
  FROM sents
), done AS (SELECT doc_id, CASE WHEN len(s.h) = 0 THEN s.o ELSE list_append(s.o, array_to_string(s.h, ' ')) END AS o FROM folded) {_EXPLODED}""")
def chunk_sentence(spark, sf_dir):
    return chunkers.chunk_sentence(table(spark, sf_dir, "documents").select("doc_id", "text"))


_CLAIM_LIST = rf"""list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]){_WS}+([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda s: regexp_replace({_trim('s')}, '(?:[.!?]|{_WS})*$', '')), lambda s: regexp_matches(s, '[\pL\pN]'))"""


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS claim_idx, c[i] AS claim FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {_CLAIM_LIST} AS c FROM documents))")
def atomic_claims(spark, sf_dir):
    return chunkers.claims(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "claim_idx", "claim")


# Retrieval and reranking


def _chunks(spark, sf_dir) -> DataFrame:
    return chunkers.chunk_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _benchmark(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hits(spark, sf_dir, k: int = 10) -> DataFrame:
    queries = _benchmark(spark, sf_dir)
    hits = retrieval.bm25(_chunks(spark, sf_dir), queries, k, keep=("doc_id",)).withColumnRenamed("chunk_id", "_hit")
    # hits are k a query, so that their number is known; only their documents are cut into chunks again
    if queries.limit(retrieval.BROADCAST_ROWS).count() * k <= retrieval.BROADCAST_ROWS:
        hits = F.broadcast(hits)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").join(hits, "doc_id")
    found = chunkers.chunk_fixed(documents).where("chunk_id = _hit").drop("_hit", "position")
    return found.join(queries.withColumnRenamed("text", "query_text"), "query_id")


@query(f"WITH {_BM25} SELECT n AS n_chunks, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM post) AS n_postings, (SELECT count(*) FROM df) AS n_terms FROM st")
def bm25_stats(spark, sf_dir):
    chunks, wanted = _chunks(spark, sf_dir), retrieval.query_terms(_benchmark(spark, sf_dir))
    index = retrieval.document_frequencies(chunks, wanted)
    sizes = index.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"), F.count(F.lit(1)).alias("n_terms"))
    return retrieval.corpus_stats(chunks).select("n_chunks", r6("avgdl", "avgdl")).crossJoin(sizes)  # one row each


@query(f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank < 10")
def bm25_topk(spark, sf_dir):
    """From an index of blocks of postings, of which the search skips those that cannot matter."""
    built = index.build(_chunks(spark, sf_dir)).save(work_dir(spark, "index"))
    return index.search(built, _benchmark(spark, sf_dir), 10).hits.select("query_id", "chunk_id", r6("score", "score"), "rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) - 1 AS rank FROM s) WHERE rank < 10""")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, 10).select("query_id", "chunk_id", r6("score", "score"), "rank")


_HIT30 = f"""{_BM25},
h30 AS (SELECT r.query_id, r.chunk_id, r.rank, c.text, b.text AS query_text FROM ranked r JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = r.query_id WHERE r.rank < 30),
j30 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {_jaccard("query_text", "text")} DESC, rank) - 1 AS rank FROM h30),
f AS (SELECT query_id, chunk_id, sum(1.0 / (61 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM h30 UNION ALL SELECT query_id, chunk_id, rank FROM j30) GROUP BY ALL)"""


@query(f"WITH {_HIT30} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) - 1 AS rank FROM f) WHERE rank < 10")
def hybrid_rrf(spark, sf_dir):
    first = _hits(spark, sf_dir, retrieval.oversample(10, 10))
    second = rerank.lexical_overlap(first, 30)
    return retrieval.rrf([first, second], 10).select("query_id", "chunk_id", r6("score", "score"), "rank")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, rank FROM hits WHERE rank < 3")
def rerank_identity(spark, sf_dir):
    return rerank.identity(retrieval.bm25(_chunks(spark, sf_dir), _benchmark(spark, sf_dir), 10), 3).select("query_id", "chunk_id", "rank")


@query(f"WITH {_RERANK} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM reranked WHERE rank < 3")
def rerank_jaccard(spark, sf_dir):
    return rerank.lexical_overlap(_hits(spark, sf_dir), 3).select("query_id", "chunk_id", r6("score", "score"), "rank")


# Generation


def _items(spark, sf_dir) -> DataFrame:
    return _benchmark(spark, sf_dir).withColumnRenamed("text", "question")


@query(f"WITH {_BM25} SELECT b.item_id AS query_id, coalesce(h.text, 'INSUFFICIENT_CONTEXT') AS text FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id AND h.rank = 0")
def answer_echo(spark, sf_dir):
    return generate.echo(_items(spark, sf_dir), _hits(spark, sf_dir)).select("query_id", "text")


_FIRST = rf"{_trim(f"string_split(regexp_replace(h.text, '([.!?]){_WS}+', '\\1' || chr(1)), chr(1))[1]")}"


@query(f"WITH {_BM25} SELECT b.item_id AS query_id, coalesce({_FIRST}, 'INSUFFICIENT_CONTEXT') AS text FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id AND h.rank = 0")
def answer_extractive(spark, sf_dir):
    return generate.extractive(_items(spark, sf_dir), _hits(spark, sf_dir)).select("query_id", "text")


_CONTEXT = f"""{_BM25},
blocks AS (SELECT query_id, rank, '[' || (rank + 1) || '] ' || text AS block FROM hits),
used AS (SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks),
ok AS (SELECT *, min(CAST(before + length(block) <= 8000 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS ok FROM used),
ctx AS (SELECT query_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (ok = 1), '') AS context FROM ok GROUP BY query_id)"""


@query(f"WITH {_CONTEXT} SELECT query_id, context FROM ctx")
def context_pack(spark, sf_dir):
    return generate.context(_hits(spark, sf_dir))


_PROMPT = generate.PROMPT.replace("'", "''")


@query(f"WITH {_CONTEXT} SELECT b.item_id AS query_id, replace(replace('{_PROMPT}', '{{question}}', b.text), '{{context}}', coalesce(context, '')) AS prompt FROM benchmark b LEFT JOIN ctx c ON c.query_id = b.item_id")
def prompt_template(spark, sf_dir):
    return generate.prompts(_items(spark, sf_dir), _hits(spark, sf_dir)).select("query_id", "prompt")


_MODEL = "CASE WHEN source = 'src0' THEN 'gpt-4o' WHEN source = 'src1' THEN 'gemini-1.5-flash' WHEN source = 'src2' THEN 'no-such-model' ELSE 'gpt-5-mini' END"
_RATE_ROWS = ", ".join(f"('{m}', {i}, {o})" for m, i, o in generate.RATES)


@query(f"""SELECT doc_id, m AS model, round((greatest(n_chars // 4 - 2, 0) * coalesce(i, 0.0) + (n_chars // 40) * coalesce(o, 0.0)) / 1e6, 9) AS cost_usd, x IS NULL AS unknown_model_rate
FROM (SELECT doc_id, n_chars, {_MODEL} AS m FROM documents) LEFT JOIN (VALUES {_RATE_ROWS}) r(x, i, o) ON m = x""")
def cost_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MODEL).alias("model"), F.expr("n_chars div 4 - 2").alias("prompt_tokens"), F.expr("n_chars div 40").alias("completion_tokens"))
    return generate.with_cost(rows).select("doc_id", "model", F.round("cost_usd", 9).alias("cost_usd"), "unknown_model_rate")


# Metrics


def _golds(spark, sf_dir) -> DataFrame:
    """Items with the documents that contain them: the items are a stated set, and each task holds them against its own documents."""
    found = retrieval.containing(table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir)).select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
    golds = found.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("gold_passages"))
    return _benchmark(spark, sf_dir).select("query_id").join(golds, "query_id", "left")


@query(f"WITH {_GOLDS} SELECT b.item_id AS query_id, array_to_string(gold_passages, ',') AS golds FROM benchmark b LEFT JOIN golds g ON g.query_id = b.item_id")
def gold_match(spark, sf_dir):
    return _golds(spark, sf_dir).select("query_id", F.array_join("gold_passages", ",").alias("golds"))


def _retrieval_sql(hits: str) -> str:
    flagged = f"""{_GOLDS},
hg AS (SELECT g.query_id, h.rank, h.chunk_id, h.doc_id, h.text, g.gold_passages FROM golds g JOIN {hits} h USING (query_id) WHERE h.rank < 10),
fl AS (SELECT query_id, rank, len(list_filter(gold_passages, lambda g: g = chunk_id OR g = CAST(doc_id AS VARCHAR) OR (length(g) >= 8 AND contains(lower(text), lower(g))))) > 0 AS hit,
  list_filter(gold_passages, lambda g: g = chunk_id OR g = CAST(doc_id AS VARCHAR) OR (length(g) >= 8 AND contains(lower(text), lower(g)))) AS which FROM hg),
ag AS (SELECT query_id, len(list_distinct(flatten(list(which)))) AS found, sum(CASE WHEN hit THEN 1.0 / log2(rank + 2) ELSE 0 END) AS dcg, min(CASE WHEN hit THEN rank END) AS first FROM fl GROUP BY query_id)"""
    idcg = "list_sum(list_transform(range(0, least(len(gold_passages), 10)), lambda i: 1.0 / log2(i + 2)))"
    return f"""{flagged}
SELECT b.item_id AS query_id, round(CASE WHEN gold_passages IS NOT NULL THEN coalesce(found, 0) / len(gold_passages) END, 6) AS recall_at_10,
  round(CASE WHEN gold_passages IS NOT NULL THEN coalesce(dcg, 0) / {idcg} END, 6) AS ndcg_at_10, round(CASE WHEN gold_passages IS NOT NULL THEN coalesce(1.0 / (first + 1), 0.0) END, 6) AS mrr_at_10
FROM benchmark b LEFT JOIN golds g ON g.query_id = b.item_id LEFT JOIN ag a ON a.query_id = b.item_id"""


def _named(scores: DataFrame, suffix: str = "") -> DataFrame:
    return scores.select("query_id", *[r6(f"`{m}@10{suffix}`", f"{m}_at_10") for m in ("recall", "ndcg", "mrr")])


@query(f"WITH {_BM25}, {_retrieval_sql('hits')}")
def retrieval_metrics(spark, sf_dir):
    return _named(metrics.retrieval_scores(_golds(spark, sf_dir), _hits(spark, sf_dir), 10))


@query(f"WITH {_RERANK}, {_retrieval_sql('reranked')}")
def retrieval_metrics_reranked(spark, sf_dir):
    return _named(metrics.retrieval_scores(_golds(spark, sf_dir), rerank.lexical_overlap(_hits(spark, sf_dir), 10), 10, "_reranked"), "_reranked")


@query(f"""WITH {_BM25}, {_GOLDS},
fl AS (SELECT h.query_id, min(h.rank) AS first FROM hits h JOIN golds g USING (query_id) WHERE list_contains(gold_passages, CAST(h.doc_id AS VARCHAR)) GROUP BY 1),
per AS (SELECT g.query_id, coalesce(1.0 / (first + 1), 0.0) AS mrr FROM golds g LEFT JOIN fl USING (query_id))
SELECT round(avg(mrr), 6) AS mean, count(*) AS n FROM per""")
def mean_mrr(spark, sf_dir):
    """The flagship: chunk, index, retrieve, score and aggregate."""
    scored = metrics.retrieval_scores(_golds(spark, sf_dir), _hits(spark, sf_dir), 10)
    rows = scored.select(F.lit("mrr@10").alias("metric"), F.col("query_id").alias("item_id"), F.col("`mrr@10`").alias("score"))
    return stats.means(stats.item_means(rows, ["metric"]), ["metric"]).select(r6("mean", "mean"), "n")


_TURNS = "turns AS (SELECT a.conv_id, a.turn, a.text, list(u.text ORDER BY u.turn) AS gold_answers FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn < a.turn AND u.role = 'user' WHERE a.role = 'assistant' GROUP BY ALL)"


def _turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    golds = c.where("role = 'user'").select("conv_id", F.col("turn").alias("_turn"), F.col("text").alias("_text"))
    joined = c.where("role = 'assistant'").join(golds, "conv_id").where("_turn < turn")
    return joined.groupBy("conv_id", "turn", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("_turn", "_text"))), lambda x: x["_text"]).alias("gold_answers"))


@query(f"""WITH {_TURNS}, tk AS (SELECT conv_id, turn, {_answer("text")} AS p, list_transform(gold_answers, lambda g: {_answer("g")}) AS gs FROM turns)
SELECT conv_id, turn, round(list_max(list_transform(gs, lambda g: CASE WHEN array_to_string(p, ' ') = array_to_string(g, ' ') THEN 1.0 ELSE 0.0 END)), 6) AS exact_match,
  round(list_max(list_transform(gs, lambda g: {_f1("p", "g")})), 6) AS token_f1, round(greatest(len(p), 1) / greatest(list_max(list_transform(gs, lambda g: len(g))), 1), 6) AS length_ratio FROM tk""")
def answer_metrics(spark, sf_dir):
    text, golds = F.col("text"), F.col("gold_answers")
    return _turns(spark, sf_dir).select("conv_id", "turn", r6(metrics.exact_match(text, golds), "exact_match"), r6(metrics.token_f1(text, golds), "token_f1"), r6(metrics.length_ratio(text, golds), "length_ratio"))


# the lengths of common subsequences by rows, one token of the answer a step
@query(f"""WITH RECURSIVE {_TURNS}, tk AS (SELECT conv_id, turn, {_answer("coalesce(text, '')")} AS p, unnest(list_transform(gold_answers, lambda g: {_answer("g")})) AS g FROM turns),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM tk),
step(k, i, l) AS (
  SELECT k, 0, list_transform(range(len(g) + 1), lambda x: CAST(0 AS BIGINT)) FROM numbered
  UNION ALL
  SELECT s.k, s.i + 1, list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len(g) + 1), lambda j: [greatest(l[j + 1], l[j] + CAST(p[s.i + 1] = g[j] AS BIGINT))])),
    lambda acc, e: list_append(acc, greatest(acc[-1], e[1]))) FROM step s JOIN numbered n ON n.k = s.k WHERE s.i < len(p)
)
SELECT conv_id, turn, round(max(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS DOUBLE) ELSE 2.0 * l[-1] / (len(p) + len(g)) END), 6) AS rouge_l
FROM step s JOIN numbered n ON n.k = s.k AND s.i = len(p) GROUP BY conv_id, turn""")
def rouge_l(spark, sf_dir):
    return rouge.with_rouge_l(_turns(spark, sf_dir)).select("conv_id", "turn", r6("rouge_l", "rouge_l"))


@query(f"SELECT conv_id, turn, {_norm("coalesce(text, '')")} AS text FROM conversations")
def normalize_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_answer(F.coalesce("text", F.lit(""))).alias("text"))


_ANSWERED = f"""{_BM25}, {_GOLDS},
an AS (SELECT b.item_id AS query_id, CASE WHEN h.score >= 60 THEN h.text ELSE 'INSUFFICIENT_CONTEXT' END AS text, g.gold_passages IS NOT NULL AS answerable
  FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id AND h.rank = 0 LEFT JOIN golds g ON g.query_id = b.item_id),
ab AS (SELECT *, contains({_norm("text")}, 'insufficient context') AS abst FROM an)"""


@query(f"""WITH {_ANSWERED} SELECT query_id, CASE WHEN NOT answerable THEN CAST(abst AS DOUBLE) END AS abstention_recall, CASE WHEN abst THEN CAST(NOT answerable AS DOUBLE) END AS abstention_precision,
  CAST(abst <> answerable AS DOUBLE) AS nrr_f1 FROM ab""")
def abstention_metrics(spark, sf_dir):
    strong = _hits(spark, sf_dir).where("score >= 60")
    answers = generate.echo(_items(spark, sf_dir), strong).join(_golds(spark, sf_dir), "query_id")
    text, ok = F.col("text"), F.col("gold_passages").isNotNull()
    return answers.select("query_id", metrics.abstention_recall(text, ok).alias("abstention_recall"), metrics.abstention_precision(text, ok).alias("abstention_precision"), metrics.right_decision(text, ok).alias("nrr_f1"))


_COUNTER = f"""cf AS (SELECT d.doc_id, coalesce(d.text, '') AS text, CASE l.quality WHEN 1 THEN 'plausible' WHEN 0 THEN 'implausible' END AS kind, array_to_string(({_tokens("coalesce(d.text, '')")})[3:4], ' ') AS counter,
  [array_to_string(({_tokens("coalesce(d.text, '')")})[1:2], ' '), 'no such words'] AS golds FROM documents d JOIN labels l USING (doc_id))"""


@query(f"""WITH {_COUNTER}, n AS (SELECT doc_id, kind, {_norm("text")} AS t, counter, {_norm("counter")} AS c, list_transform(golds, lambda g: {_norm("g")}) AS gs FROM cf)
SELECT doc_id, CASE WHEN kind = 'plausible' AND counter <> '' THEN CAST(contains(t, c) AS DOUBLE) END AS plausible_compliance,
  CASE WHEN kind = 'implausible' THEN CAST(len(list_filter(gs, lambda g: contains(t, g))) > 0 AND NOT (counter <> '' AND contains(t, c)) AS DOUBLE) END AS implausible_resistance FROM n""")
def counterfactual_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    tok = T.tokens(F.col("text"))
    rows = rows.select(
        "doc_id", "text", F.when(F.col("quality") == 1, "plausible").when(F.col("quality") == 0, "implausible").alias("kind"), F.array_join(F.slice(tok, 3, 2), " ").alias("counter"),
        F.array(F.array_join(F.slice(tok, 1, 2), " "), F.lit("no such words")).alias("golds"))
    text, kind, counter = F.col("text"), F.col("kind"), F.col("counter")
    return rows.select("doc_id", metrics.plausible_compliance(text, kind, counter).alias("plausible_compliance"), metrics.implausible_resistance(text, kind, counter, F.col("golds")).alias("implausible_resistance"))


@query("""SELECT source, round(CASE WHEN clean > 0 THEN 1 - noisy / clean ELSE 0 END, 6) AS noise_vulnerability,
  round(list_avg(list_filter([CASE WHEN clean IS NOT NULL THEN greatest(0.0, 1 - (CASE WHEN clean > 0 THEN 1 - noisy / clean ELSE 0 END)) END, q, t], lambda x: x IS NOT NULL)), 6) AS composite
FROM (SELECT source, avg(CASE WHEN toxic = 0 THEN quality END) AS clean, coalesce(avg(CASE WHEN toxic = 1 THEN quality END), 0) AS noisy, avg(quality) AS q, avg(toxic) AS t FROM documents JOIN labels USING (doc_id) GROUP BY source)""")
def robustness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(
        F.avg(F.when(F.col("toxic") == 0, F.col("quality"))).alias("clean"), F.coalesce(F.avg(F.when(F.col("toxic") == 1, F.col("quality"))), F.lit(0.0)).alias("noisy"),
        F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    v = metrics.noise_vulnerability(F.col("clean"), F.col("noisy"))
    shown = F.when(F.col("clean").isNotNull(), v)
    return rows.select("source", r6(v, "noise_vulnerability"), r6(metrics.adversarial_composite(shown, F.col("q"), F.col("t"), F.lit(None).cast("double")), "composite"))


def _verdict(claim: str, context: str) -> str:
    words = f"list_filter(list_filter(regexp_split_to_array(replace({claim}, ',', ' '), '{_WS}+'), lambda t: t <> ''), lambda t: length(t) > 2)"
    return f"CASE WHEN starts_with({claim}, 'NOT-') THEN 'refuted' WHEN len({words}) > 0 AND len(list_filter({words}, lambda t: NOT contains(lower({context}), lower(t)))) = 0 THEN 'supported' ELSE 'neutral' END"


_JUDGES = [metrics.Judge("a", "anthropic"), metrics.Judge("b", "openai"), metrics.Judge("c", "openweight")]

_FAITH = f"""{_BM25},
sc3 AS (SELECT query_id, string_agg('[' || (rank + 1) || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits WHERE rank < 3 GROUP BY query_id),
cl0 AS (SELECT item_id AS query_id, {_CLAIM_LIST} AS c FROM benchmark),
cl AS (SELECT query_id, i AS claim_idx, c[i] AS claim, CASE WHEN query_id % 2 = 0 THEN 'openai' ELSE 'other' END AS family FROM (SELECT query_id, c, unnest(range(1, len(c) + 1)) AS i FROM cl0)),
jd AS (SELECT query_id, claim_idx, j, {_verdict("claim", "context")} AS verdict FROM cl JOIN sc3 USING (query_id) CROSS JOIN (VALUES ('a', 'anthropic'), ('b', 'openai'), ('c', 'openweight')) t(j, jf) WHERE jf <> family),
vt AS (SELECT query_id, claim_idx, CASE WHEN 2 * count(*) FILTER (verdict = 'supported') > count(*) THEN 'supported' WHEN count(*) FILTER (verdict = 'refuted') > count(*) FILTER (verdict = 'supported') THEN 'refuted' ELSE 'neutral' END AS v FROM jd GROUP BY ALL),
fs AS (SELECT query_id, avg(CASE WHEN v = 'supported' THEN 1.0 ELSE 0.0 END) AS f FROM vt GROUP BY query_id)"""


@query(f"WITH {_FAITH} SELECT b.item_id AS query_id, round(f, 6) AS faithfulness FROM benchmark b LEFT JOIN fs ON fs.query_id = b.item_id")
def faithfulness_dummy(spark, sf_dir):
    """The benchmark passages themselves as answers, judged against what was retrieved for them."""
    hits = _hits(spark, sf_dir).where("rank < 3")
    answers = _benchmark(spark, sf_dir).withColumn("family", F.when(F.col("query_id") % 2 == 0, "openai").otherwise("other"))
    return metrics.faithfulness(answers, generate.context(hits, 1 << 30), _JUDGES).select("query_id", r6("faithfulness", "faithfulness"))


@query(rf"""SELECT conv_id, turn, CASE WHEN starts_with(w, 'support') THEN 'supported' WHEN starts_with(w, 'refut') THEN 'refuted' ELSE 'neutral' END AS verdict
FROM (SELECT conv_id, turn, regexp_replace(({_tokens("lower((CASE turn % 3 WHEN 0 THEN 'Supported, ' WHEN 1 THEN '.Refutes ' ELSE '' END) || coalesce(text, ''))")})[1], '^[.,]+|[.,]+$', '', 'g') AS w FROM conversations)""")
def parse_verdict(spark, sf_dir):
    said = F.concat(F.when(F.col("turn") % 3 == 0, "Supported, ").when(F.col("turn") % 3 == 1, ".Refutes ").otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.parse_verdict(said).alias("verdict"))


@query(f"""WITH {_BM25}, o AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY md5('0:' || rank), text) AS i FROM hits)
SELECT query_id, string_agg('[' || i || '] ' || text, chr(10) || chr(10) ORDER BY i) AS context FROM o GROUP BY query_id""")
def shuffled_context(spark, sf_dir):
    return metrics.shuffled_context(_hits(spark, sf_dir))


# Statistics

_RATED = "rated AS (SELECT lang, CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS b FROM labels JOIN documents USING (doc_id))"


def _alpha_sql(keys: str) -> str:
    by, using = (f"GROUP BY {keys}", f"JOIN s USING ({keys})") if keys else ("", "CROSS JOIN s")
    lead = f"{keys}, " if keys else ""
    return f"""WITH {_RATED}, g AS (SELECT {lead}count(*) AS n, count(*) FILTER (a <> b) AS d FROM rated {by}),
v AS (SELECT {lead}v, count(*) AS c FROM (SELECT {lead}a AS v FROM rated UNION ALL SELECT {lead}b FROM rated) GROUP BY {lead}v), s AS (SELECT {lead}sum(c * (c - 1)) AS same, count(*) AS kinds FROM v {by})
SELECT {lead}round(CASE WHEN n = 1 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END WHEN kinds < 2 OR 1 - same / (2.0 * n * (2 * n - 1)) = 0 THEN 1.0 ELSE 1 - (d * 1.0 / n) / (1 - same / (2.0 * n * (2 * n - 1))) END, 6) AS alpha, n FROM g {using}"""


def _rated(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("lang", F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))


@query(_alpha_sql(""))
def alpha_overall(spark, sf_dir):
    return stats.krippendorff(_rated(spark, sf_dir)).select(r6("alpha", "alpha"), "n")


@query(_alpha_sql("lang"))
def alpha_by_family(spark, sf_dir):
    return stats.krippendorff(_rated(spark, sf_dir), ["lang"]).select("lang", r6("alpha", "alpha"), "n")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit("events").alias("task_id"), F.col("event_type").alias("metric"), F.col("user_id").alias("item_id"), (F.col("event_id") % 5).alias("seed"), F.col("value").alias("score"))


_ITEM = "im AS (SELECT event_type AS metric, user_id AS item_id, avg(value) AS score FROM events WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_ITEM} SELECT metric, round(avg(score), 6) AS mean, count(*) AS n FROM im GROUP BY metric")
def seed_item_mean(spark, sf_dir):
    return stats.means(stats.item_means(_events(spark, sf_dir), ["metric"]), ["metric"]).select("metric", r6("mean", "mean"), "n")


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(max(CASE WHEN i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN value END), 6) AS p95
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def latency_p95(spark, sf_dir):
    return stats.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", r6("mean", "mean"), r6("p95", "p95"))


_LANGS = "it AS (SELECT lang AS metric, doc_id AS item_id, avg(quality) AS score FROM labels JOIN documents USING (doc_id) GROUP BY ALL)"


def _lang_items(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy(F.col("lang").alias("metric"), F.col("doc_id").alias("item_id")).agg(F.avg("quality").alias("score"))


def _drawn(items: str, key: str) -> str:
    """CTEs hs, ws and bm (key, b, m): means of the items' resamples."""
    hs = f"hs AS (SELECT {key}, score, b, md5('0:' || b || ':' || item_id) AS h FROM (SELECT {key}, score, item_id, unnest(range(0, {stats.RESAMPLES // 4})) AS b FROM {items}))"
    draw = "CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)"
    weight = " + ".join(f"CAST(u >= {limit} AS INTEGER)" for limit in stats.LIMITS)
    ws = f"ws AS (SELECT {key}, score, 4 * b + k AS b, {weight} AS w FROM (SELECT {key}, score, b, k, {draw} AS u FROM (SELECT *, unnest(range(0, 4)) AS k FROM hs)))"
    return f"{hs}, {ws}, bm AS (SELECT {key}, b, sum(w * score) / nullif(sum(w), 0) AS m FROM ws GROUP BY ALL)"


@query(f"""WITH {_LANGS}, sz AS (SELECT metric, avg(score) AS mean, count(*) AS n FROM it GROUP BY metric), {_drawn("it", "metric")}
SELECT metric, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi, any_value(n) AS n FROM bm JOIN sz USING (metric) GROUP BY metric""")
def bootstrap_ci(spark, sf_dir):
    return stats.native_intervals(_lang_items(spark, sf_dir), ["metric"]).select("metric", r6("mean", "mean"), r6("ci_lo", "ci_lo"), r6("ci_hi", "ci_hi"), "n")


@query()
def bootstrap_exact(spark, sf_dir):
    return stats.exact_intervals(_lang_items(spark, sf_dir), ["metric"])


@query()
def bootstrap_bca(spark, sf_dir):
    return stats.exact_intervals(_lang_items(spark, sf_dir), ["metric"], method="bca")


@query(f"""WITH pr AS (SELECT source AS item_id, avg(quality) - avg(1 - toxic) AS score, 0 AS g FROM labels JOIN documents USING (doc_id) GROUP BY source), {_drawn("pr", "g")},
rm AS (SELECT round(m, 9) AS m FROM bm)
SELECT round(least(1.0, 2 * least(avg(CAST(m >= 0 AS DOUBLE)), avg(CAST(m <= 0 AS DOUBLE)))), 6) AS p_value, (SELECT count(*) FROM pr) AS n FROM rm""")
def paired_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    pairs = rows.groupBy(F.col("source").alias("item_id")).agg(F.avg("quality").alias("a"), F.avg(1 - F.col("toxic")).alias("b"))
    return stats.native_paired_p(pairs).select(r6("p_value", "p_value"), "n")


# Splits, hashes, checks, leaderboard


@query("SELECT item_id, CASE WHEN row_number() OVER (ORDER BY CAST(item_id AS VARCHAR)) > n - floor(n * 0.2) THEN 'holdout' ELSE 'public' END AS split FROM (SELECT item_id, count(*) OVER () AS n FROM benchmark)")
def split_holdout(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return tasks.split_items(items, "holdout").withColumn("split", F.lit("holdout")).unionByName(tasks.split_items(items, "public").withColumn("split", F.lit("public")))


@query("""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS id, item_id || '|' || text || '|' || 'x,' || ';' || item_id || ',' || chr(10) AS line FROM benchmark),
d AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id || '|' || sha256(text) || chr(10) AS line FROM documents)
SELECT 'needle' AS task_id, sha256('task_id:needle' || chr(10) || 'items:' || chr(10) || (SELECT string_agg(line, '' ORDER BY id, line) FROM i) || 'corpus:' || chr(10) || (SELECT string_agg(line, '' ORDER BY id, line) FROM d)) AS task_data_hash""")
def task_data_hash(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("question"), F.array(F.lit("x")).alias("gold_answers"), F.array(F.col("item_id").cast("string")).alias("gold_passages"))
    return repro.task_data_hash("needle", items, table(spark, sf_dir, "documents").select("doc_id", "text"))


_RUNS = """runs AS (SELECT CAST(user_id AS VARCHAR) AS pipeline_hash, event_type AS task_id, avg(value) AS mean, avg(value) - 10 AS ci_lo, avg(value) + 10 AS ci_hi, count(*) AS n, avg(abs(value)) AS cost, max(value) AS latency FROM events GROUP BY ALL)"""


def _runs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("pipeline_hash"), F.col("event_type").alias("task_id")).agg(
        F.avg("value").alias("mean"), (F.avg("value") - 10).alias("ci_lo"), (F.avg("value") + 10).alias("ci_hi"), F.count(F.lit(1)).alias("n"), F.avg(F.abs("value")).alias("cost"), F.max("value").alias("latency"))


_METRIC_NAME = "CASE WHEN n % 2 = 0 THEN 'token_f1' ELSE 'length_ratio' END"


@query(f"""WITH {_RUNS}, s AS (SELECT task_id || '-' || pipeline_hash AS task_id, 'm' AS metric, ci_lo, ci_hi FROM runs), re AS (SELECT e.event_type || '-' || e.user_id AS task_id, 'm' AS metric, median(value) * 3 AS mean FROM events e GROUP BY ALL)
SELECT task_id, CASE WHEN t THEN 'm' END AS metric, CASE WHEN NOT t THEN task_id || ': re-run missing' WHEN mean IS NULL THEN task_id || '/m: re-run metric missing' ELSE 'outside' END AS kind
FROM (SELECT s.task_id, re.mean, s.ci_lo, s.ci_hi, s.task_id IN (SELECT task_id FROM re) AS t FROM s LEFT JOIN re ON re.task_id = s.task_id AND re.metric = s.metric) WHERE NOT t OR mean IS NULL OR mean < ci_lo OR mean > ci_hi""")
def verify_run(spark, sf_dir):
    name = F.concat_ws("-", "task_id", "pipeline_hash")
    submitted = _runs(spark, sf_dir).select(name.alias("task_id"), F.lit("m").alias("metric"), "ci_lo", "ci_hi")
    rerun = table(spark, sf_dir, "events").groupBy(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("task_id"), F.lit("m").alias("metric")).agg((F.median("value") * 3).alias("mean"))
    return repro.verify_run(submitted, rerun).select("task_id", "metric", F.when(F.contains("reason", F.lit("outside")), "outside").otherwise(F.col("reason")).alias("kind"))


@query(f"""WITH {_RUNS}, s AS (SELECT pipeline_hash AS h, count(*) AS nt, list(task_id ORDER BY task_id) AS ts FROM runs GROUP BY 1)
SELECT h AS pipeline_hash, 'error' AS severity, 'Bad pipeline_hash format: ' || h AS message FROM s UNION ALL
SELECT h, 'error', 'pipeline_yaml is empty' FROM s WHERE CAST(h AS BIGINT) % 2 = 0 UNION ALL
SELECT h, 'warning', '<5 seeds (' || nt || '); submission discouraged for leaderboard' FROM s WHERE nt < 5 UNION ALL
SELECT pipeline_hash, 'error', 'Task ' || task_id || ': missing task_data_hash' FROM runs WHERE n % 2 = 0 UNION ALL
SELECT pipeline_hash, 'error', 'Task ' || task_id || '/token_f1: missing mean or ci_95' FROM runs WHERE n % 3 = 0 UNION ALL
SELECT h, 'error', 'Missing required tasks: ' || array_to_string(list_filter(['nq-1k', 'hotpotqa-1k', 'noisy-qa', 'unanswerable-qa'], lambda t: NOT list_contains(ts, t)), ', ') FROM s""")
def validate(spark, sf_dir):
    task = F.struct(
        F.when(F.col("n") % 2 == 0, "").otherwise("x").alias("task_data_hash"),
        F.create_map(F.lit("token_f1"), F.struct(F.when(F.col("n") % 3 != 0, F.col("mean")).alias("mean"), F.array("ci_lo", "ci_hi").alias("ci_95"), F.col("n"))).alias("metrics"))
    subs = _runs(spark, sf_dir).groupBy("pipeline_hash").agg(F.map_from_entries(F.collect_list(F.struct("task_id", task.alias("t")))).alias("tasks"), F.collect_list(F.lit(1)).alias("seeds"))
    return repro.validate(subs.withColumn("pipeline_yaml", F.when(F.col("pipeline_hash").cast("long") % 2 == 0, " ").otherwise("x")))


_BOARD = f"""{_RUNS}, q AS (SELECT pipeline_hash, coalesce(avg(CASE WHEN {_METRIC_NAME} = 'token_f1' THEN mean END), 0) AS quality, avg(cost) AS cost, greatest(max(latency), 0) AS latency,
  coalesce(bool_or({_METRIC_NAME} = 'length_ratio' AND mean > 10), false) AS is_verbose FROM runs GROUP BY 1), e AS (SELECT pipeline_hash, round(quality, 3) AS quality, round(cost, 1) AS cost, latency, is_verbose FROM q)"""


def _board(spark, sf_dir) -> DataFrame:
    runs = _runs(spark, sf_dir)
    named = runs.withColumn("metric", F.expr(_METRIC_NAME))
    q, v = leaderboard.quality(named), leaderboard.verbose(named)
    costs = leaderboard.roll_up(runs)
    return q.join(v, "pipeline_hash").join(costs, "pipeline_hash").select("pipeline_hash", halves_up("quality", 3).alias("quality"), halves_up("cost_per_query_usd_mean", 1).alias("cost"), F.col("latency_ms_p95").alias("latency"), F.col("verbose").alias("is_verbose"))


@query(f"WITH {_BOARD} SELECT pipeline_hash, quality, cost, round(latency, 6) AS latency, is_verbose FROM e")
def leaderboard_rollup(spark, sf_dir):
    return _board(spark, sf_dir).select("pipeline_hash", "quality", "cost", r6("latency", "latency"), "is_verbose")


@query(f"WITH {_BOARD} SELECT a.pipeline_hash, NOT EXISTS (SELECT 1 FROM e b WHERE b.quality >= a.quality AND b.cost <= a.cost AND (b.quality > a.quality OR b.cost < a.cost)) AS pareto FROM e a")
def pareto_front(spark, sf_dir):
    return leaderboard.pareto(_board(spark, sf_dir)).select("pipeline_hash", "pareto")


@query(f"WITH {_BOARD}, m AS (SELECT log10(min(greatest(cost, 1e-5))) AS lo, log10(max(greatest(cost, 1e-5))) AS hi, max(quality) AS q FROM e) SELECT pipeline_hash, round(CASE WHEN hi > lo THEN (log10(greatest(cost, 1e-5)) - lo) / (hi - lo) ELSE 0 END, 6) AS x, round(CASE WHEN q > 0 THEN quality / q ELSE 0 END, 6) AS y FROM e CROSS JOIN m")
def pareto_scatter(spark, sf_dir):
    return leaderboard.scatter(_board(spark, sf_dir)).select("pipeline_hash", r6("x", "x"), r6("y", "y"))


@query("""WITH j AS (SELECT j, lang AS f, CAST(CASE j WHEN 'q' THEN quality ELSE 1 - toxic END AS VARCHAR) AS verdict FROM labels JOIN documents USING (doc_id) CROSS JOIN (VALUES ('q'), ('t')) v(j))
SELECT j AS judge, verdict, count(*) AS n FROM j GROUP BY ALL""")
def judge_verdict_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    each = F.explode(F.array(F.struct(F.lit("q").alias("judge"), F.col("quality").cast("string").alias("verdict")), F.struct(F.lit("t").alias("judge"), (1 - F.col("toxic")).cast("string").alias("verdict"))))
    judged = rows.select(F.col("lang").alias("task_family"), F.col("quality").cast("string").alias("gold_verdict"), each.alias("x")).select("task_family", "gold_verdict", "x.*")
    return stats.calibration(judged)[2]


@query("SELECT doc_id, text FROM (SELECT role || '-' || turn AS doc_id, text, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1")
def corpus_first(spark, sf_dir):
    """The first text of each id, as a corpus of paragraphs is made from records."""
    c = table(spark, sf_dir, "conversations")
    return tasks.first_of_each(c.select(F.concat_ws("-", "role", F.col("turn").cast("string")).alias("doc_id"), "text", F.col("conv_id").alias("record"), F.col("turn").alias("place"))).select("doc_id", "text")


@query(f"WITH {_BOARD} SELECT pipeline_hash, row_number() OVER (ORDER BY quality DESC, pipeline_hash) AS place FROM e WHERE NOT is_verbose")
def leaderboard_view(spark, sf_dir):
    """Verified entries in the order of the site, numbered."""
    board = _board(spark, sf_dir).select("pipeline_hash", "quality", F.struct(F.col("cost").alias("cost_per_query_usd_mean"), F.col("latency").alias("latency_ms_p95")).alias("operational"), (~F.col("is_verbose")).alias("verified"))
    return numbered(leaderboard.view(board), [F.desc("quality"), "pipeline_hash"], "place").select("pipeline_hash", "place")


# Records, models and files


_SPLIT = _tokens("coalesce(text, '')")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, lang AS question, array_to_string(t[1:3], ' ') AS answer, text AS document_text, source AS document_title FROM (SELECT *, {_SPLIT} AS t FROM documents) WHERE len(t) > 0")
def nq_records(spark, sf_dir):
    """Documents as published records of questions, whose answer is the span of their first three words."""
    span = F.struct(F.array().cast("array<string>").alias("text"), F.array(F.lit(0)).alias("start_token"), F.array(F.lit(3)).alias("end_token"))
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.struct(F.col("lang").alias("text")).alias("question"), F.col("text").alias("document_text"), F.struct(F.col("source").alias("title")).alias("document"),
        F.struct(F.array(span).alias("short_answers")).alias("annotations"))
    return tasks.map_nq(raw).select("id", "question", F.col("answers")[0].alias("answer"), "document_text", "document_title")


_LISTED = "SELECT conv_id, list(role || turn ORDER BY turn) AS ts, list(coalesce(text, '') ORDER BY turn) AS xs FROM conversations GROUP BY conv_id"


def _conversations(spark, sf_dir) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed.alias("x"))


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS id, ts[i] AS title, trim(xs[i], ' ') || ' end' AS text, i = 2 AS is_gold FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM ({_LISTED}))""")
def hotpot_records(spark, sf_dir):
    """Conversations as published records of titles and sentences, whose second turn supports the answer."""
    titles = F.transform("x", lambda t: F.concat(t["role"], t["turn"].cast("string")))
    raw = _conversations(spark, sf_dir).select(
        F.col("conv_id").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.struct(F.filter(F.array(F.get(titles, F.lit(1))), lambda t: t.isNotNull()).alias("title")).alias("supporting_facts"),
        F.struct(titles.alias("title"), F.transform("x", lambda t: F.array(t["text"], F.lit(" end"))).alias("sentences")).alias("context"))
    return tasks.map_hotpot(raw).select("id", F.explode("paragraphs").alias("p")).select("id", "p.title", "p.text", "p.is_gold")


@query(f"""SELECT 'msm-' || conv_id || '-' || (i - 1) AS id, xs[i] AS text, i = 1 AS is_gold, ts[i] AS url FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM ({_LISTED}))""")
def msmarco_records(spark, sf_dir):
    """Conversations as published records of passages, of which the first is selected."""
    passages = F.struct(
        F.transform("x", lambda t, i: (i == 0).cast("int")).alias("is_selected"), F.transform("x", lambda t: t["text"]).alias("passage_text"), F.transform("x", lambda t: F.concat(t["role"], t["turn"].cast("string"))).alias("url"))
    raw = _conversations(spark, sf_dir).select(F.col("conv_id").alias("query_id"), F.lit("q").alias("query"), F.array(F.lit("a"), F.lit("")).alias("answers"), passages.alias("passages"))
    return tasks.map_msmarco(raw).select(F.explode("paragraphs").alias("p")).select("p.id", "p.text", "p.is_gold", "p.url")


@query(f"WITH {_BM25}, s AS (SELECT query_id, chunk_id, CAST(-abs(length(query_text) - length(text)) AS DOUBLE) AS score, rank AS r FROM hits) SELECT query_id, chunk_id, score, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) - 1 AS i FROM s) WHERE i < 3")
def rerank_model(spark, sf_dir):
    """Hits by a model that likes chunks of the query's length."""
    return rerank.cross_encoder(_hits(spark, sf_dir), lambda pairs: [-abs(len(q) - len(t)) for q, t in pairs], 3).select("query_id", "chunk_id", "score", "rank")


def _one_of_seven(texts: list[str]):
    import numpy as np

    return np.eye(7)[[len(t) % 7 for t in texts]] * 3.0


@query("""WITH s AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, CAST(length(b.text) % 7 = length(coalesce(d.text, '')) % 7 AS DOUBLE) AS score FROM benchmark b CROSS JOIN documents d)
SELECT query_id, chunk_id, score, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS i FROM s) WHERE i < 5""")
def dense_embedded(spark, sf_dir):
    """Nearest documents by an encoder that knows a text's length alone."""
    vectors = retrieval.embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), _one_of_seven)
    return retrieval.dense(vectors, retrieval.embed(_benchmark(spark, sf_dir), _one_of_seven), 5).select("query_id", "chunk_id", "score", "rank")


_RATE_4O = next((i, o) for m, i, o in generate.RATES if m == "gpt-4o")


@query(f"SELECT doc_id, trim(left(coalesce(text, ''), 12), ' ' || chr(10) || chr(9)) AS answer, CAST(length(coalesce(text, '')) // 4 AS INTEGER) AS prompt_tokens, round((length(coalesce(text, '')) // 4 * {_RATE_4O[0]} + 5 * {_RATE_4O[1]}) / 1e6, 9) AS cost_usd FROM documents")
def model_answers(spark, sf_dir):
    """Answers of a model that says the first characters of its prompt."""
    prompted = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("seed"), F.col("text").alias("prompt"))
    said = generate.by_model(prompted, lambda: lambda prompt, o: (prompt[:12], len(prompt) // 4, 5), {"model": "gpt-4o", "temperature": 0.0, "max_tokens": 5}, "openai")
    return said.select("doc_id", F.col("text").alias("answer"), "prompt_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query("""WITH r AS (SELECT source, lang, avg(quality) AS q, count(*) AS n, avg(n_chars) / 1000.0 AS cost FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
e AS (SELECT coalesce(source, 'none') AS pipeline_hash, avg(q) AS quality, avg(cost) AS cost FROM r GROUP BY ALL)
SELECT pipeline_hash, round(quality, 6) AS quality, round(cost, 6) AS cost, array_to_string(list_filter([CASE WHEN NOT EXISTS (SELECT 1 FROM e b WHERE b.quality >= a.quality AND b.cost <= a.cost AND (b.quality > a.quality OR b.cost < a.cost)) THEN 'pareto' END], lambda t: t IS NOT NULL), ',') AS tags FROM e a""")
def leaderboard_from_files(spark, sf_dir):
    """Sources as pipelines and languages as tasks, written as submission files and read back."""

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    runs = rows.groupBy(F.coalesce("source", F.lit("none")).alias("source"), "lang").agg(F.avg("quality").alias("q"), F.count(F.lit(1)).alias("n"), (F.avg("n_chars") / 1000.0).alias("cost"))
    metric = F.create_map(F.lit("token_f1"), F.struct(F.col("q").alias("mean"), F.array("q", "q").alias("ci_95"), "n"))
    figure = F.struct(F.col("cost").alias("mean"), F.col("cost").alias("p95"))
    task = F.struct(F.lit("x").alias("task_data_hash"), F.col("n").alias("n_items"), F.array(F.lit(0)).alias("seeds"), metric.alias("metrics"), figure.alias("cost_per_query_usd"), figure.alias("latency_ms"), F.lit(1.0).alias("wall_time_s"))
    subs = runs.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("lang").alias("k"), task.alias("v")))).alias("tasks"))
    subs = subs.select(
        F.lit("1").alias("version"), F.col("source").alias("pipeline_hash"), F.lit("name: x").alias("pipeline_yaml"), F.col("source").alias("pipeline_name"), F.struct(F.lit("n").alias("name"), F.lit("").alias("contact")).alias("submitter"),
        F.array(F.lit(0)).alias("seeds"), "tasks", F.lit(1.0).alias("total_wall_time_s"), F.lit("2020-01-01T00:00:00Z").alias("submitted_at"))
    # a file a pipeline, of which there are few, in the folder that driver and executors share
    folder = work_dir(spark, "submissions")
    subs.write.option("maxRecordsPerFile", 1).json(folder)
    board = leaderboard.leaderboard(submissions.read_submissions(spark, folder))
    return board.select("pipeline_hash", r6("quality", "quality"), r6("operational.cost_per_query_usd_mean", "cost"), F.array_join("tags", ",").alias("tags"))
