"""Queries of the operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, divergence, jaccard_join, license_scan, line_dedup, mixing, quality_model, quality_rules, sentence_pieces, spelling, substring_dedup, token_count, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_read(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.cascade(docs, report=True).select("doc_id", *quality_rules.REPORT, "base_failed", "kept")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("places")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents"), extend=True).select("doc_id", "removed_lines", "text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_quality_model, op3_mixing, op4_token_output, op5_substring_dedup, op6_jaccard_join, op7_token_count, op8_quality_rules, op9_license_scan, op10_line_dedup, op11_source_divergence, op12_sentence_pieces, op13_spelling_variants)
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), h AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS n_bullets,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipses
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS upper_,
         CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS letters,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > CAST(0.3 AS DOUBLE) * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR upper_ > CAST(0.6 AS DOUBLE) * letters OR n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines OR n_bullets > CAST(0.9 AS DOUBLE) * n_lines
            OR n_ellipses > CAST(0.3 AS DOUBLE) * n_lines OR 2 * n_letter_words < n_words) AS kept
FROM b
""",
}

#: Brute force: all pairs of documents that share a shingle, and everything that can be reached by links.
ORACLE_SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id
)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links FROM d
"""


#: Every kept term in every group, whether it occurs there or not.
ORACLE_SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT k, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), f AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n, l.v, l.total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(own + 5 * v AS HUGEINT) AS BIGINT) AS p,
         CAST(1 + (1000000000 * CAST(lang_n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS BIGINT) AS q
  FROM f
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

#: Noise by crc32 over bytes, near words by wildcards and deletions in all places, chains by recursion.
ORACLE_SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE k(i, x, s) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, s + 1 FROM k WHERE s < 8
), crc AS MATERIALIZED (
  SELECT list(x ORDER BY i) AS c FROM k WHERE s = 8
), o AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) || ':' || w AS key, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
  ) WHERE length(w) >= 5 GROUP BY ALL
), h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(key))), lambda i: CAST('0x' || substr(hex(encode(key)), 2 * i + 1, 2) AS BIGINT))),
         lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]))) AS h
  FROM o, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), p AS (
  SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT x.word, y.word AS near, y.n AS near_n FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT p.word, w.word, w.n FROM p JOIN words w ON w.word = p.a || p.b
  UNION SELECT w.word, p.word, p.n FROM p JOIN words w ON w.word = p.a || p.b
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word
), f AS MATERIALIZED (
  SELECT w.word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain(word, root) AS (
  SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT max_by(c.root, g.n) FROM chain c JOIN f g ON g.word = c.root WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f
"""


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _license_sql(index: license_scan.Index) -> str:
    """All words of all files against all postings, grouped by template and relative position."""
    posts = [(w, k, p) for w, own in zip(index.vocabulary, index.postings, strict=True) for k, p in own]
    templates = [(k, t.label, index.need[k], index.most[k]) for k, t in enumerate(index.templates)]
    mandatory = [(k, f" {m} ") for k, t in enumerate(index.templates) for m in t.mandatory]
    base = [(f" {phrase} ", label, len(phrase.split()), phrase.split()[0]) for phrase, label in license_scan.BASE]
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w FROM documents
), t AS (
  SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)
), n AS (
  SELECT doc_id, k, count(*) AS n FROM t JOIN (VALUES {_values(posts)}) v(word, k, p) USING (word) GROUP BY doc_id, k, i - p
), best AS (
  SELECT doc_id, k, max(n) AS n FROM n GROUP BY ALL
), found AS (
  SELECT doc_id, label FROM best JOIN (VALUES {_values(templates)}) v(k, label, need, most) USING (k) JOIN d USING (doc_id)
  WHERE n >= need AND k NOT IN (SELECT m.k FROM (VALUES {_values(mandatory)}) m(k, phrase) WHERE NOT contains(' ' || array_to_string(w, ' ') || ' ', phrase))
), places AS (
  SELECT doc_id, i, label FROM t JOIN d USING (doc_id) JOIN (VALUES {_values(base)}) b(phrase, label, size, word) USING (word)
  WHERE ' ' || array_to_string(w[i + 1 : i + size], ' ') || ' ' = phrase
), score AS (
  SELECT doc_id, max(n / most) AS score FROM best JOIN (VALUES {_values(templates)}) v(k, label, need, most) USING (k) GROUP BY doc_id
), b AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM places p WHERE p.doc_id = d.doc_id), '') AS base_labels,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found) x WHERE x.doc_id = d.doc_id), '') AS labels,
       coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN score USING (doc_id)
"""


ORACLE_SQL["op9_license_scan"] = _license_sql(license_scan.Index())

#: Every kept term in every group, whether it occurs there or not.
ORACLE_SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT k, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), f AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n, l.v, l.total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // CAST(own + 5 * v AS HUGEINT) AS BIGINT) AS p,
         CAST(1 + (1000000000 * CAST(lang_n + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS BIGINT) AS q
  FROM f
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

#: Noise by crc32 over bytes, near words by wildcards and deletions in all places, chains by recursion.
ORACLE_SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE k(i, x, s) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, s + 1 FROM k WHERE s < 8
), crc AS MATERIALIZED (
  SELECT list(x ORDER BY i) AS c FROM k WHERE s = 8
), o AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) || ':' || w AS key, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
  ) WHERE length(w) >= 5 GROUP BY ALL
), h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(key))), lambda i: CAST('0x' || substr(hex(encode(key)), 2 * i + 1, 2) AS BIGINT))),
         lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]))) AS h
  FROM o, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), p AS (
  SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT x.word, y.word AS near, y.n AS near_n FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT p.word, w.word, w.n FROM p JOIN words w ON w.word = p.a || p.b
  UNION SELECT w.word, p.word, p.n FROM p JOIN words w ON w.word = p.a || p.b
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word
), f AS MATERIALIZED (
  SELECT w.word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain(word, root) AS (
  SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT max_by(c.root, g.n) FROM chain c JOIN f g ON g.word = c.root WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f
"""


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _license_sql(index: license_scan.Index) -> str:
    """All words of all files against all postings, grouped by template and relative position."""
    posts = [(w, k, p) for w, own in zip(index.vocabulary, index.postings, strict=True) for k, p in own]
    templates = [(k, t.label, index.need[k], index.most[k]) for k, t in enumerate(index.templates)]
    mandatory = [(k, f" {m} ") for k, t in enumerate(index.templates) for m in t.mandatory]
    base = [(f" {phrase} ", label, len(phrase.split()), phrase.split()[0]) for phrase, label in license_scan.BASE]
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w FROM documents
), t AS (
  SELECT doc_id, w[i + 1] AS word, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)
), n AS (
  SELECT doc_id, k, count(*) AS n FROM t JOIN (VALUES {_values(posts)}) v(word, k, p) USING (word) GROUP BY doc_id, k, i - p
), best AS (
  SELECT doc_id, k, max(n) AS n FROM n GROUP BY ALL
), found AS (
  SELECT doc_id, label FROM best JOIN (VALUES {_values(templates)}) v(k, label, need, most) USING (k) JOIN d USING (doc_id)
  WHERE n >= need AND k NOT IN (SELECT m.k FROM (VALUES {_values(mandatory)}) m(k, phrase) WHERE NOT contains(' ' || array_to_string(w, ' ') || ' ', phrase))
), places AS (
  SELECT doc_id, i, label FROM t JOIN d USING (doc_id) JOIN (VALUES {_values(base)}) b(phrase, label, size, word) USING (word)
  WHERE ' ' || array_to_string(w[i + 1 : i + size], ' ') || ' ' = phrase
), score AS (
  SELECT doc_id, max(n / most) AS score FROM best JOIN (VALUES {_values(templates)}) v(k, label, need, most) USING (k) GROUP BY doc_id
), b AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM places p WHERE p.doc_id = d.doc_id), '') AS base_labels,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found) x WHERE x.doc_id = d.doc_id), '') AS labels,
       coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN score USING (doc_id)
"""


ORACLE_SQL["op9_license_scan"] = _license_sql(license_scan.Index())

#: All pairs of lines that follow each other, against the first place of each.
ORACLE_SQL["op10_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), p AS (
  SELECT doc_id, i, l[i] || chr(10) || l[i + 1] AS pair FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM d) WHERE regexp_matches(l[i] || l[i + 1], '[^ 	-
]')
), f AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(i) OVER w AS first_i FROM p WINDOW w AS (PARTITION BY pair ORDER BY doc_id, i)
), gone AS (
  SELECT doc_id, list_distinct(flatten(list([i, i + 1]))) AS g FROM f
  WHERE (doc_id, i) <> (first_doc, first_i) AND NOT (doc_id = first_doc AND i = first_i + 1) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(g), 0) AS BIGINT) AS removed_lines,
       CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text
FROM d LEFT JOIN gone USING (doc_id)
"""
