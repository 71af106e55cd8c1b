"""Text functions as Column expressions: they stay in the JVM and follow Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` and ``\s`` take it, for Java's regex engine.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What the answer normaliser removes, and the abstention phrase.
ARTICLES = ("a", "an", "the")
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
ABSTAINS = "insufficient context"
SENTINEL = "INSUFFICIENT_CONTEXT"
#: Word patterns of the retriever and of the overlap reranker.
TERM = r"[A-Za-z0-9]+(?:'[a-z]+)?"
OVERLAP_TERM = r"[A-Za-z0-9]+"


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """The parts between white space, none of them empty."""
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda t: t != "")


def terms(text: Column) -> Column:
    """Words of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def overlap_terms(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(OVERLAP_TERM), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 if one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def answer_tokens(text: Column) -> Column:
    """Tokens of an answer: lower case, punctuation is space, articles are left out."""
    spaced = F.regexp_replace(F.lower(text), PUNCTUATION, " ")
    return F.filter(F.split(F.regexp_replace(spaced, r"(?U)\b(?:a|an|the)\b", " "), f"{SPACE}+", -1), lambda t: t != "")


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def is_abstention(text: Column) -> Column:
    """Whether the normalised text has the abstention phrase."""
    return F.contains(normalize_answer(text), F.lit(ABSTAINS))


def once(value: Column, fn) -> Column:
    """``fn(value)`` with the value made once, however often ``fn`` speaks of it: as a lambda's variable."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def numbered(tokens: Column) -> Column:
    """A multiset as a set: each token with a number among its equals."""
    return once(F.array_sort(tokens), lambda s: F.transform(s, lambda t, i: F.concat(t, F.lit("\u0000"), i + 1 - F.array_position(s, t))))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over two multisets of tokens, both ``numbered``."""
    common = F.size(F.array_intersect(prediction, gold))
    n, m = F.size(prediction), F.size(gold)
    return (
        F.when((n == 0) & (m == 0), 1.0)
        .when((n == 0) | (m == 0) | (common == 0), 0.0)
        .otherwise(2.0 * common / (n + m))
    )


def best_over(golds: Column, fn) -> Column:
    """Largest value of ``fn`` over the golds; 0.0 if there are none."""
    return F.coalesce(F.array_max(F.transform(golds, fn)), F.lit(0.0))


def sentences(text: Column) -> Column:
    """Sentences: cut at white space between an end mark and a capital or quote; trimmed, none of them empty."""
    cut = F.split(text, rf"""(?<=[.!?]){SPACE}+(?=[A-Z"'])""", -1)
    return F.filter(F.transform(cut, trimmed), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    return trimmed(F.get(F.split(text, rf"(?<=[.!?]){SPACE}+", 2), F.lit(0)))


def atomic_claims(text: Column) -> Column:
    """Sentences without their end marks, those that have a letter or digit."""
    cut = F.split(text, rf"""(?<=[.!?]){SPACE}+(?=[A-Z"'(\[])""", -1)
    bare = F.transform(cut, lambda s: F.regexp_replace(trimmed(s), rf"(?:[.!?]|{SPACE})*$", ""))
    return F.filter(bare, lambda s: F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")))
