"""Task sources: corpora (doc_id, text, ...) and items as DataFrames.

Items have task_id, item_id, question, gold_answers, gold_passages (null where
a task has none), corpus_ref, answerable, counter_kind, counter_answer and ordinal (the
place in the task; null where ids give the order).
Seed tasks are read from rows in memory; dataset tasks from files of raw
records (Parquet or JSON) that are mapped, filtered and limited in Spark.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.partitions import numbered
from plumbline.sources.records import count as count_records
from plumbline.sources.records import files as record_files
from plumbline.sources.records import first_records

ITEMS = (
    "task_id string, item_id string, question string, gold_answers array<string>, gold_passages array<string>, corpus_ref string, answerable boolean, counter_kind string, counter_answer string, ordinal bigint"
)
CORPUS = "doc_id string, text string, role string, ordinal bigint"
SPLITS = ("public", "holdout", "all")


@dataclass(frozen=True)
class Spec:
    """What is known of a task without reading it."""

    id: str
    name: str
    family: str
    size: int
    contamination_risk: str
    language: str = "en"
    metrics_retrieval: tuple[str, ...] = ()
    metrics_generation: tuple[str, ...] = ("exact_match", "token_f1")
    metrics_end_to_end: tuple[str, ...] = ()
    license: str = "Apache-2.0"
    upstream_url: str = ""

    def as_json(self) -> dict[str, Any]:
        return {
            "id": self.id, "name": self.name, "family": self.family, "size": self.size, "contamination_risk": self.contamination_risk, "language": self.language,
            "metrics": {"retrieval": list(self.metrics_retrieval), "generation": list(self.metrics_generation), "end_to_end": list(self.metrics_end_to_end)},
            "license": self.license, "upstream_url": self.upstream_url,
        }


@dataclass
class Task:
    """A task: its spec and functions of a session that give corpus and items."""

    spec: Spec
    corpus: Callable[[SparkSession], DataFrame]
    items: Callable[[SparkSession, str], DataFrame]
    options: dict[str, Any] = field(default_factory=dict)


_tasks: dict[str, Callable[..., Task]] = {}


def register_task(task_id: str):
    """Register a maker of a task; another one under the same id is an error."""

    def keep(make: Callable[..., Task]) -> Callable[..., Task]:
        if _tasks.get(task_id, make) is not make:
            raise ValueError(f"task {task_id!r} is registered already")
        _tasks[task_id] = make
        return make

    return keep


def get_task(task_id: str, **options: Any) -> Task:
    if task_id not in _tasks:
        raise KeyError(f"no task {task_id!r}; there are {list_tasks()}")
    return _tasks[task_id](**options)


def list_tasks() -> list[str]:
    return sorted(_tasks)


#: Suites and the tasks that they stand for.
SUITES = {
    "v1.0-suite": ("nq-1k", "hotpotqa-1k", "noisy-qa", "unanswerable-qa"),
    "v1.0-all": ("nq-1k", "hotpotqa-1k", "msmarco-1k", "noisy-qa", "unanswerable-qa", "counterfactual-qa"),
    "adversarial": ("noisy-qa", "unanswerable-qa", "counterfactual-qa"),
    "smoke": ("synthetic-10",),
}


def expand(names: str) -> list[str]:
    """Task ids of a comma-separated list of tasks and suites, each once, in order."""
    listed = [t for name in map(str.strip, names.split(",")) if name for t in SUITES.get(name, (name,))]
    return list(dict.fromkeys(listed))


def metric_names(spec: Spec, k: int = 10) -> list[str]:
    """The metrics that a run of the task reports."""
    out = [f"{m}@{k}" for m in ("recall", "ndcg", "mrr")] if spec.metrics_retrieval else []
    out += ["token_f1", "exact_match", "length_ratio"] if spec.metrics_generation else []
    out += ["abstention_recall", "abstention_precision", "nrr_f1"] if spec.id == "unanswerable-qa" else []
    return out + (["plausible_compliance", "implausible_resistance"] if spec.id == "counterfactual-qa" else [])


def split_items(items: DataFrame, split: str, key: str = "item_id", share: float = 0.2) -> DataFrame:
    """The last ``floor(share * n)`` items by id are held out, the others public."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    if split == "all":
        return items
    placed = numbered(items.withColumn("_key", F.col(key).cast("string")), ["_key"], "_place").drop("_key")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    marked = placed.crossJoin(F.broadcast(n)).withColumn("_held", F.col("_place") > F.col("_n") - F.floor(F.col("_n") * F.lit(share)))  # one row
    return marked.where("_held" if split == "holdout" else "not _held").drop("_held", "_place", "_n")


def _row(task_id: str, item_id: str, question: str, answers: Sequence[str], passages: Sequence[str] | None, ref: str, answerable: bool | None = None, kind: str | None = None, counter: str | None = None) -> tuple:
    return task_id, item_id, question, list(answers), None if passages is None else list(passages), ref, answerable, kind, counter


def _fixed(spec: Spec, docs: list[tuple[str, str, str | None]], rows: list[tuple], holdout: bool = True) -> Task:
    numbered = [(*d, i) for i, d in enumerate(docs)]
    return Task(
        spec, lambda spark: spark.createDataFrame(numbered, CORPUS),
        lambda spark, split="all": spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] if holdout or split != "holdout" else [], ITEMS))


def synthetic(corpus: Sequence[tuple[str, str]], items: Sequence[tuple[str, str, Sequence[str], Sequence[str]]], task_id: str = "synthetic-10") -> Task:
    """From (doc_id, text) and (item_id, question, answers, passages); nothing is held out."""
    spec = Spec(task_id, "Synthetic", "single-hop-qa", len(items), "novel", metrics_retrieval=("recall@5", "mrr@5"))
    return _fixed(spec, [(d, t, None) for d, t in corpus], [_row(task_id, i, q, a, p, f"{task_id}-corpus") for i, q, a, p in items], holdout=False)


def noisy(rows: Sequence[tuple[str, str, str, str, str, Sequence[str]]], task_id: str = "noisy-qa") -> Task:
    """From (item_id, question, answer, gold_id, gold_text, distractors): a gold document and its distractors for each item."""
    spec = Spec(task_id, task_id, "adversarial", len(rows), "low", metrics_retrieval=("recall@10", "mrr@10"), metrics_end_to_end=("answer_relevance", "faithfulness"))
    docs = [d for _, _, _, g, text, others in rows for d in ((g, text, "gold"), *((f"{g}-d{j}", t, "distractor") for j, t in enumerate(others)))]
    return _fixed(spec, docs, [_row(task_id, i, q, [a], [g], f"{task_id}-seed-v1", True) for i, q, a, g, _, _ in rows])


def unanswerable(rows: Sequence[tuple[str, str, Sequence[str], Sequence[tuple[str, str]], bool]], task_id: str = "unanswerable-qa") -> Task:
    """From (item_id, question, answers, documents, answerable)."""
    spec = Spec(task_id, task_id, "adversarial", len(rows), "low", metrics_end_to_end=("abstention_recall", "abstention_precision", "nrr_f1"))
    docs = [(d, t, None) for _, _, _, own, _ in rows for d, t in own]
    return _fixed(spec, docs, [_row(task_id, i, q, a, None, f"{task_id}-seed-v1", ok) for i, q, a, _, ok in rows])


def counterfactual(rows: Sequence[tuple[str, str, Sequence[str], str, str, str]], task_id: str = "counterfactual-qa") -> Task:
    """From (item_id, question, answers, context, counter answer, plausible or implausible)."""
    spec = Spec(task_id, task_id, "adversarial", len(rows), "low", metrics_retrieval=("recall@10",), metrics_end_to_end=("plausible_compliance", "implausible_resistance"))
    docs = [(f"cf-{i}", text, None) for i, _, _, text, _, _ in rows]
    return _fixed(spec, docs, [_row(task_id, i, q, a, [f"cf-{i}"], f"{task_id}-seed-v1", True, kind, counter) for i, q, a, _, counter, kind in rows])


# Datasets of raw records


def _path(raw: DataFrame, *paths: str) -> T.DataType | None:
    """The first of ``paths`` (dotted) that the records have, and its type."""
    for path in paths:
        kind: T.DataType | None = raw.schema
        for name in path.split("."):
            kind = kind[name].dataType if isinstance(kind, T.StructType) and name in kind.names else None
        if kind is not None:
            return path, kind
    return None, None


def _column(raw: DataFrame, *paths: str, kind: str = "string") -> Column:
    found, _ = _path(raw, *paths)
    return F.col(found) if found else F.lit(None).cast(kind)


def flat_nq(raw: DataFrame) -> DataFrame:
    """Records as published, with answers below ``annotations`` and texts below ``question`` and ``document``, as the columns that ``map_nq`` takes."""
    answers, kind = _path(raw, "short_answers", "annotations.short_answers")
    known = kind.elementType.names if answers and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []

    def ints(a: Column, name: str) -> Column:
        # one number, or a list of them
        if name not in known:
            return F.array().cast("array<int>")
        return a[name].cast("array<int>") if isinstance(kind.elementType[name].dataType, T.ArrayType) else F.when(a[name].isNotNull(), F.array(a[name].cast("int"))).otherwise(F.array().cast("array<int>"))

    def one(a: Column) -> Column:
        none = F.array().cast("array<string>")
        texts = none if "text" not in known else a["text"] if isinstance(kind.elementType["text"].dataType, T.ArrayType) else F.array(a["text"])
        spans = F.transform(F.arrays_zip(ints(a, "start_token").alias("s"), ints(a, "end_token").alias("e")), lambda x: F.struct(none.alias("text"), x["s"].alias("start_token"), x["e"].alias("end_token")))
        return F.concat(F.array(F.struct(texts.alias("text"), F.lit(None).cast("int").alias("start_token"), F.lit(None).cast("int").alias("end_token"))), spans)

    tokens, token_kind = _path(raw, "document.tokens")
    text = _column(raw, "document_text")
    if _path(raw, "document_text")[0] is None and tokens:
        words = F.arrays_zip(F.col(f"{tokens}.token").alias("t"), F.col(f"{tokens}.is_html").alias("h")) if isinstance(token_kind, T.StructType) else F.transform(tokens, lambda x: F.struct(x["token"].alias("t"), x["is_html"].alias("h")))
        text = F.array_join(F.transform(F.filter(words, lambda x: ~x["h"]), lambda x: x["t"]), " ")
    listed = F.flatten(F.transform(answers, one)) if known else F.array().cast("array<struct<text:array<string>,start_token:int,end_token:int>>")
    return raw.select(
        _column(raw, "id", "example_id").alias("id"), _column(raw, "question.text", "question", "question_text").alias("question"), F.coalesce(text, F.lit("")).alias("document_text"),
        _column(raw, "document_title", "document.title").alias("document_title"), listed.alias("short_answers"))


def flat_hotpot(raw: DataFrame) -> DataFrame:
    """Records as published, with titles and sentences below ``context``, as the columns that ``map_hotpot`` takes."""
    none = "array<string>"
    return raw.select(
        "id", "question", "answer", _column(raw, "titles", "context.title", kind=none).alias("titles"), _column(raw, "sentences", "context.sentences", kind="array<array<string>>").alias("sentences"),
        F.coalesce(_column(raw, "supporting", "supporting_facts.title", kind=none), F.array().cast(none)).alias("supporting"))


def flat_msmarco(raw: DataFrame) -> DataFrame:
    """Records as published, with texts, flags and urls below ``passages``, as the columns that ``map_msmarco`` takes."""
    return raw.select("query_id", "query", "answers", *[_column(raw, c, f"passages.{c}").alias(c) for c in ("passage_text", "is_selected", "url")])


def _answers(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce(F.size("answers"), F.lit(0)) > 0)


def map_nq(raw: DataFrame) -> DataFrame:
    """Records (id, question, answers, document_text, document_title) from short answers as texts or token spans."""
    raw = flat_nq(raw)
    tokens = F.filter(F.split("document_text", r"\s+"), lambda t: t != "")
    spans = F.flatten(F.transform("short_answers", lambda a: F.concat(
        F.coalesce(a["text"], F.array().cast("array<string>")),
        F.when(a["start_token"].isNotNull(), F.array(F.array_join(F.slice(tokens, a["start_token"] + 1, F.greatest(F.coalesce(a["end_token"], a["start_token"] + 1) - a["start_token"], F.lit(0))), " "))).otherwise(F.array().cast("array<string>")))))
    return _answers(raw.select(F.col("id").cast("string").alias("id"), "question", F.filter(spans, lambda s: s != "").alias("answers"), "document_text", "document_title"))


def map_hotpot(raw: DataFrame) -> DataFrame:
    """Records (id, question, answer, paragraphs) from titles, lists of sentences, and supporting titles."""
    raw = flat_hotpot(raw)
    whole = F.zip_with("titles", "sentences", lambda t, s: F.struct(t.alias("title"), F.array_join(F.transform(s, lambda x: F.trim(x)), " ").alias("text"), F.array_contains("supporting", t).alias("is_gold")))
    return raw.select(F.col("id").cast("string").alias("id"), "question", "answer", whole.alias("paragraphs"))


def map_msmarco(raw: DataFrame) -> DataFrame:
    """Records (id, question, answers, paragraphs) from passage texts, selected flags and urls."""
    raw = flat_msmarco(raw)
    zipped = F.arrays_zip(F.col("passage_text").alias("t"), F.col("is_selected").alias("s"), F.col("url").alias("u"))
    whole = F.transform(zipped, lambda p, i: F.struct(
        F.concat(F.lit("msm-"), F.col("query_id").cast("string"), F.lit("-"), i).alias("id"), p["t"].alias("text"), (p["s"].cast("int") == 1).alias("is_gold"), p["u"].alias("url")))
    answers = F.filter("answers", lambda a: F.coalesce(a, F.lit("")) != "")
    return _answers(raw.select(F.col("query_id").cast("string").alias("id"), F.col("query").alias("question"), answers.alias("answers"), whole.alias("paragraphs")))


def cached(records: DataFrame, path: str, max_items: int) -> DataFrame:
    """The first ``max_items`` records, kept as Parquet under a path that names the number, so that a smaller run spoils no larger one."""
    spark, at = records.sparkSession, f"{path}/max_items={max_items}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        records.limit(max_items).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def first_of_each(paragraphs: DataFrame) -> DataFrame:
    """One row a doc_id: the first by record and paragraph."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("record", "place"))
    return paragraphs.withColumn("_r", rank).where("_r = 1").drop("_r")


def nq_corpus(records: DataFrame) -> DataFrame:
    return first_of_each(records.select(F.concat(F.lit("nq-doc-"), "id").alias("doc_id"), F.col("document_text").alias("text"), F.col("document_title").alias("title"), F.col("id").alias("record"), F.lit(0).alias("place"))).drop("record", "place")


def nq_items(records: DataFrame, split: str = "all") -> DataFrame:
    rows = _items(records, "nq-1k", "nq-validation", F.col("answers"), F.array(F.concat(F.lit("nq-doc-"), "id")))
    return split_items(rows, split)


def _paragraph_ids(kind: str):
    """Column function of record id, place and paragraph that names a paragraph."""
    return {"hotpotqa": lambda r, i, p: F.concat(F.lit("hpqa-"), p["title"]), "msmarco": lambda r, i, p: p["id"]}[kind]


def paragraph_corpus(records: DataFrame, kind: str) -> DataFrame:
    name = _paragraph_ids(kind)
    each = records.select(F.col("id").alias("record"), F.posexplode("paragraphs").alias("place", "p"))
    return first_of_each(each.select(name(F.col("record"), F.col("place"), F.col("p")).alias("doc_id"), F.col("p.text").alias("text"), "record", "place")).drop("record", "place")


def paragraph_items(records: DataFrame, kind: str, split: str = "all") -> DataFrame:
    name = _paragraph_ids(kind)
    named = F.transform("paragraphs", lambda p, i: F.struct(name(F.col("id"), i, p).alias("d"), p["is_gold"].alias("g")))
    golds = F.transform(F.filter(named, lambda x: x["g"]), lambda x: x["d"])
    answers = F.array("answer") if "answer" in records.columns else F.col("answers")
    return split_items(_items(records, f"{kind}-1k", f"{kind}-validation", answers, golds), split)


def _items(records: DataFrame, task_id: str, ref: str, answers, passages) -> DataFrame:
    return records.select(
        F.lit(task_id).alias("task_id"), F.col("id").alias("item_id"), "question", answers.alias("gold_answers"), passages.alias("gold_passages"), F.lit(ref).alias("corpus_ref"),
        F.lit(None).cast("boolean").alias("answerable"), F.lit(None).cast("string").alias("counter_kind"), F.lit(None).cast("string").alias("counter_answer"), F.lit(None).cast("bigint").alias("ordinal"))


def _dataset(task_id: str, name: str, family: str, mapped, corpus, items):
    @register_task(task_id)
    def make(raw_path: str = "", cache_path: str = "", max_items: int = 1000) -> Task:
        def records(spark: SparkSession) -> DataFrame:
            if cache_path or "://" in raw_path.removeprefix("file://") or not os.path.exists(raw_path.removeprefix("file://")):
                raw = spark.read.json(raw_path) if raw_path.endswith((".json", ".jsonl")) else spark.read.parquet(raw_path)
                rows = mapped(raw)
                return cached(rows, cache_path, max_items) if cache_path else rows.limit(max_items)
            # records that are dropped for want of an answer are replaced by later ones
            take = max_items
            while True:
                rows = mapped(first_records(spark, raw_path, take))
                known = record_files(raw_path)
                if rows.count() >= max_items or take >= sum(map(count_records, known)):
                    return rows.limit(max_items) if take > max_items else rows
                take *= 2

        return Task(Spec(task_id, name, family, max_items, "high", metrics_retrieval=("recall@10", "ndcg@10", "mrr@10")), lambda spark: corpus(records(spark)), lambda spark, split="all": items(records(spark), split), {"max_items": max_items})

    return make


_dataset("nq-1k", "Natural Questions", "single-hop-qa", map_nq, nq_corpus, nq_items)
_dataset("hotpotqa-1k", "HotpotQA", "multi-hop-qa", map_hotpot, lambda r: paragraph_corpus(r, "hotpotqa"), lambda r, s: paragraph_items(r, "hotpotqa", s))
_dataset("msmarco-1k", "MS MARCO", "single-hop-qa", map_msmarco, lambda r: paragraph_corpus(r, "msmarco"), lambda r, s: paragraph_items(r, "msmarco", s))


# Seed rows of our own for smoke runs; ``rows_path`` names a JSON file with other rows of the same shape


def _rows(own: Sequence, rows_path: str) -> Sequence:
    if not rows_path:
        return own
    import json

    with open(rows_path, encoding="utf-8") as f:
        return json.load(f)


_FACTS = (
    ("Lake Baikal", "Lake Baikal in Siberia is the deepest lake on Earth. Its floor lies 1642 metres below the surface.", "How deep is Lake Baikal?", ("1642 metres", "1642 m")),
    ("Saturn", "Saturn has rings of ice and rock. Its largest moon is Titan.", "What is the largest moon of Saturn?", ("Titan",)),
    ("Insulin", "Insulin lowers blood sugar. It is made in the pancreas.", "Which organ makes insulin?", ("pancreas", "the pancreas")),
    ("Iceland", "Iceland lies on the Mid-Atlantic Ridge. Its capital is Reykjavik.", "What is the capital of Iceland?", ("Reykjavik",)),
    ("Copper", "Copper is a red metal with the symbol Cu. It conducts heat and electricity well.", "What is the symbol of copper?", ("Cu",)),
    ("Honey bees", "Honey bees dance to show each other where food is. A hive has one queen.", "How many queens does a hive have?", ("one", "1")),
    ("Zambezi", "The Zambezi flows east to the Indian Ocean. Victoria Falls lies on its course.", "Into which ocean does the Zambezi flow?", ("Indian Ocean",)),
    ("Sourdough", "Sourdough bread rises by wild yeast and lactic acid bacteria. Its starter is fed with flour.", "What is a sourdough starter fed with?", ("flour",)),
    ("Chess", "Each side in chess begins with sixteen pieces. A pawn that reaches the last rank is promoted.", "With how many pieces does each side begin in chess?", ("sixteen", "16")),
    ("Basalt", "Basalt is a dark volcanic rock. It forms when lava cools quickly.", "When does basalt form?", ("when lava cools quickly",)),
    ("Kilimanjaro", "Kilimanjaro is the highest mountain in Africa. It stands in Tanzania.", "In which country does Kilimanjaro stand?", ("Tanzania",)),
    ("Octopus", "An octopus has three hearts. Its blood is blue because it carries copper.", "How many hearts does an octopus have?", ("three", "3")),
    ("Barometer", "A barometer measures the pressure of the air. Torricelli made the first one with mercury.", "Who made the first barometer?", ("Torricelli",)),
    ("Helium", "Helium was first found in the light of the Sun. It is the second lightest element.", "Where was helium first found?", ("in the light of the Sun", "the Sun")),
    ("Danube", "The Danube rises in the Black Forest. It ends in a delta at the Black Sea.", "Where does the Danube rise?", ("in the Black Forest", "Black Forest")),
    ("Paper", "Paper was first made in China. Rags and bark were beaten to a pulp for it.", "In which country was paper first made?", ("China",)),
    ("Violin", "A violin has four strings. They are tuned in fifths.", "How many strings does a violin have?", ("four", "4")),
    ("Penicillin", "Penicillin was found by Alexander Fleming in 1928. A mould had spoilt one of his dishes.", "Who found penicillin?", ("Alexander Fleming", "Fleming")),
    ("Jupiter", "Jupiter turns once in about ten hours. It is the largest planet.", "How long does Jupiter take to turn once?", ("about ten hours", "ten hours")),
    ("Saffron", "Saffron comes from the flowers of a crocus. Its threads are picked by hand.", "From which flower does saffron come?", ("crocus", "a crocus")),
    ("Sahara", "The Sahara is the largest hot desert. It covers much of North Africa.", "What is the largest hot desert?", ("the Sahara", "Sahara")),
    ("Amber", "Amber is the hardened resin of trees. Insects are sometimes kept inside it.", "What is amber made of?", ("the hardened resin of trees", "resin")),
    ("Marathon", "A marathon is run over 42.195 kilometres. The distance was fixed in 1921.", "When was the distance of the marathon fixed?", ("1921",)),
    ("Hummingbird", "A hummingbird can fly backwards. Its wings beat some fifty times a second.", "Which bird can fly backwards?", ("hummingbird", "a hummingbird")),
    ("Aluminium", "Aluminium is won from bauxite. Much current is needed for that.", "From which ore is aluminium won?", ("bauxite",)),
)


@register_task("synthetic-10")
def _synthetic(rows_path: str = "") -> Task:
    own = [[(f"doc-{i}", text) for i, (_, text, _, _) in enumerate(_FACTS[:10], 1)], [(f"s{i}", q, list(a), [f"doc-{i}"]) for i, (_, _, q, a) in enumerate(_FACTS[:10], 1)]]
    corpus, items = _rows(own, rows_path)
    return synthetic(corpus, items)


@register_task("noisy-qa")
def _noisy(rows_path: str = "") -> Task:
    # the distractors of a fact are the texts of the three facts after it
    own = [(f"n{i}", q, a[0], f"n{i}-gold", text, [_FACTS[(i + j) % len(_FACTS)][1] for j in range(3)]) for i, (_, text, q, a) in enumerate(_FACTS, 1)]
    return noisy(_rows(own, rows_path))


@register_task("unanswerable-qa")
def _unanswerable(rows_path: str = "") -> Task:
    # twelve items of twenty have a corpus without the answer: the texts of other facts
    own = []
    for i, (_, text, q, a) in enumerate(_FACTS[:20], 1):
        ok = i % 5 in (2, 4)
        texts = [text if ok else _FACTS[i % len(_FACTS)][1], _FACTS[(i + 3) % len(_FACTS)][1]]
        own.append((f"u{i}", q, list(a) if ok else [], [(f"u{i}-c{j}", t) for j, t in enumerate(texts, 1)], ok))
    return unanswerable(_rows(own, rows_path))


_COUNTER = (
    ("1642 metres", "1580 metres", "plausible"), ("Titan", "Rhea", "plausible"), ("pancreas", "liver", "plausible"), ("Reykjavik", "Akureyri", "plausible"),
    ("Cu", "Zz", "implausible"), ("one", "ninety", "implausible"), ("Indian", "Arctic", "implausible"), ("flour", "gravel", "implausible"),
    ("sixteen", "fifteen", "plausible"), ("cools quickly", "cools slowly", "plausible"), ("Tanzania", "Kenya", "plausible"), ("three", "two", "plausible"),
    ("Torricelli", "a talking parrot", "implausible"), ("the Sun", "a teapot", "implausible"), ("the Black Forest", "a bathtub", "implausible"), ("China", "the Moon", "implausible"),
)


@register_task("counterfactual-qa")
def _counterfactual(rows_path: str = "") -> Task:
    own = [(f"cf{i}", q, list(a), text.replace(true, false), false, kind) for i, ((_, text, q, a), (true, false, kind)) in enumerate(zip(_FACTS, _COUNTER, strict=False), 1)]
    return counterfactual(_rows(own, rows_path))
