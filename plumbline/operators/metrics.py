"""Metrics: a score for each (item, seed), null where the metric does not apply.

Retrieval metrics take items (query_id, gold_passages) and hits (query_id,
rank, chunk_id, doc_id, text); the others are Column expressions over one row
of text, gold_answers, answerable, counter_kind and counter_answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import store

VERBOSE = 10.0
#: Least length of a gold passage that may be found inside a chunk's text.
SUBSTRING_CHARS = 8


def is_gold(gold: Column, chunk_id: Column, doc_id: Column, text: Column) -> Column:
    """A gold passage names the chunk or its document, or stands in its text."""
    inside = (F.length(gold) >= SUBSTRING_CHARS) & F.contains(F.lower(text), F.lower(gold))
    return (chunk_id == gold) | (doc_id.cast("string") == gold) | inside


def retrieval_scores(items: DataFrame, hits: DataFrame, k: int = 10, suffix: str = "") -> DataFrame:
    """``query_id`` with recall, ndcg and mrr at k; items without gold passages get nulls.

    Golds meet the hits of their own query alone, k at most, in one row.
    """
    cut = hits.where(F.col("rank") < k)
    # k hits a query at most
    listed = cut.groupBy("query_id").agg(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")).alias("hits"))
    rows = items.select("query_id", "gold_passages").join(listed, "query_id", "left")
    golds, found = F.col("gold_passages"), F.coalesce(F.col("hits"), F.slice(F.col("hits"), 1, 0))

    def hit(g: Column, h: Column) -> Column:
        return F.coalesce(is_gold(g, h["chunk_id"], h["doc_id"], h["text"]), F.lit(False))

    recall = F.size(F.filter(F.array_distinct(golds), lambda g: F.exists(found, lambda h: hit(g, h)))) / F.size(golds)
    ranks = F.transform(F.filter(found, lambda h: F.exists(golds, lambda g: hit(g, h))), lambda h: h["rank"])
    discount = lambda r: 1.0 / F.log2(r + 2.0)
    total = lambda xs: F.aggregate(F.transform(xs, discount), F.lit(0.0), lambda a, x: a + x)
    ideal = total(F.sequence(F.lit(0), F.least(F.size(golds), F.lit(k)) - 1))
    applies = F.coalesce(F.size(golds), F.lit(0)) > 0
    none = F.col("hits").isNull()
    score = lambda c: F.when(applies, F.when(none, 0.0).otherwise(c))
    return rows.select(
        "query_id", score(recall).alias(f"recall@{k}{suffix}"), score(total(ranks) / ideal).alias(f"ndcg@{k}{suffix}"),
        score(F.when(F.size(ranks) > 0, 1.0 / (F.array_min(ranks) + 1)).otherwise(0.0)).alias(f"mrr@{k}{suffix}"))


def _if_golds(golds: Column, score: Column) -> Column:
    return F.when(F.coalesce(F.size(golds), F.lit(0)) > 0, score)


def exact_match(text: Column, golds: Column) -> Column:
    best = T.once(T.normalize_answer(text), lambda mine: T.best_over(golds, lambda g: (mine == T.normalize_answer(g)).cast("double")))
    return _if_golds(golds, best)


def token_f1(text: Column, golds: Column) -> Column:
    best = T.once(T.numbered(T.answer_tokens(text)), lambda mine: T.best_over(golds, lambda g: T.token_f1(mine, T.numbered(T.answer_tokens(g)))))
    return _if_golds(golds, best)


def length_ratio(text: Column, golds: Column) -> Column:
    """Tokens of the answer to those of the longest gold, each 1 at least."""
    longest = F.array_max(F.transform(golds, lambda g: F.size(T.answer_tokens(g))))
    return _if_golds(golds, F.greatest(F.size(T.answer_tokens(text)), F.lit(1)) / F.greatest(longest, F.lit(1)))


def abstention_recall(text: Column, answerable: Column) -> Column:
    return F.when(answerable == F.lit(False), T.is_abstention(text).cast("double"))


def abstention_precision(text: Column, answerable: Column) -> Column:
    return F.when(T.is_abstention(text), F.coalesce(~answerable, F.lit(False)).cast("double"))


def right_decision(text: Column, answerable: Column) -> Column:
    """Abstained where it should, answered where it should; null if unknown which."""
    return F.when(answerable.isNotNull(), (T.is_abstention(text) != answerable).cast("double"))


def plausible_compliance(text: Column, kind: Column, counter: Column) -> Column:
    applies = (kind == "plausible") & (F.coalesce(counter, F.lit("")) != "")
    return F.when(applies, F.contains(T.normalize_answer(text), T.normalize_answer(counter)).cast("double"))


def implausible_resistance(text: Column, kind: Column, counter: Column, golds: Column) -> Column:
    mine = T.normalize_answer(text)
    applies = (kind == "implausible") & (F.coalesce(F.size(golds), F.lit(0)) > 0)
    truth = F.exists(golds, lambda g: F.contains(mine, T.normalize_answer(g)))
    fooled = (F.coalesce(counter, F.lit("")) != "") & F.contains(mine, T.normalize_answer(F.coalesce(counter, F.lit(""))))
    return F.when(applies, (truth & ~fooled).cast("double"))


def noise_vulnerability(clean: Column, noisy: Column) -> Column:
    return F.when(clean > 0, 1 - noisy / clean).otherwise(0.0)


def adversarial_composite(vulnerability: Column, nrr: Column, plausible: Column, implausible: Column) -> Column:
    """Mean of the parts that are known; 0 if none is."""
    parts = F.filter(F.array(F.when(vulnerability.isNotNull(), F.greatest(F.lit(0.0), 1 - vulnerability)), nrr, plausible, implausible), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.0)


#: Text metrics by name, as expressions over the columns of a scored row.
TEXT_METRICS: dict[str, Callable[[], Column]] = {
    "token_f1": lambda: token_f1(F.col("text"), F.col("gold_answers")),
    "exact_match": lambda: exact_match(F.col("text"), F.col("gold_answers")),
    "length_ratio": lambda: length_ratio(F.col("text"), F.col("gold_answers")),
    "abstention_recall": lambda: abstention_recall(F.col("text"), F.col("answerable")),
    "abstention_precision": lambda: abstention_precision(F.col("text"), F.col("answerable")),
    "nrr_f1": lambda: right_decision(F.col("text"), F.col("answerable")),
    "plausible_compliance": lambda: plausible_compliance(F.col("text"), F.col("counter_kind"), F.col("counter_answer")),
    "implausible_resistance": lambda: implausible_resistance(F.col("text"), F.col("counter_kind"), F.col("counter_answer"), F.col("gold_answers")),
}


# Faithfulness: claims of an answer, judged against its context


@dataclass(frozen=True)
class Judge:
    """Who judges: name, family, model and the hash of the prompt; ``connect`` gives a function of (claim, context), or None for the rule of ``dummy_verdict``."""

    name: str
    family: str = "openweight"
    model: str = "dummy-v1"
    prompt_hash: str = "sha256:dummy"
    connect: Callable[[], Callable[[str, str], str]] | None = None


#: Fixed value: the judges' prompt.
CLAIM_PROMPT = """\
You are checking whether a single atomic claim is entailed by a provided context.

CONTEXT:
{context}

CLAIM:
{claim}

Respond with EXACTLY ONE WORD from: supported, refuted, neutral
- "supported" if the context entails the claim.
- "refuted"   if the context contradicts the claim.
- "neutral"   if the context neither supports nor refutes the claim.

VERDICT:"""


def dummy_verdict(claim: Column, context: Column) -> Column:
    """``NOT-`` refutes; otherwise all words of more than two characters must stand in the context."""
    words = F.filter(T.tokens(F.replace(claim, F.lit(","), F.lit(" "))), lambda t: F.length(t) > 2)
    inside = F.forall(words, lambda t: F.contains(F.lower(context), F.lower(t)))
    return F.when(F.startswith(claim, F.lit("NOT-")), "refuted").when((F.size(words) > 0) & inside, "supported").otherwise("neutral")


def parse_verdict(text: Column) -> Column:
    """A verdict from what a model says, by its first word."""
    word = F.regexp_replace(F.get(T.tokens(F.lower(text)), F.lit(0)), r"^[.,]+|[.,]+$", "")
    return F.when(F.startswith(word, F.lit("support")), "supported").when(F.startswith(word, F.lit("refut")), "refuted").otherwise("neutral")


def majority(supported: Column, refuted: Column, n: Column) -> Column:
    return F.when(2 * supported > n, "supported").when(refuted > supported, "refuted").otherwise("neutral")


def shuffled_context(hits: DataFrame, seed: Column | None = None) -> DataFrame:
    """``query_id, context``: the numbered hits of each query in a random but fixed order."""
    seed = F.lit(0) if seed is None else seed
    # hits of a query are at most the k of the ranking
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.md5(F.concat_ws(":", seed.cast("string"), "rank").cast("binary")).alias("o"), F.col("text").alias("t")))), lambda x: x["t"])
    listed = hits.groupBy("query_id").agg(texts.alias("texts"))
    return listed.select("query_id", F.array_join(F.transform("texts", lambda t, i: F.concat(F.lit("["), i + 1, F.lit("] "), t)), "\n\n").alias("context"))


def judged_by_model(pairs: DataFrame, judges: list[Judge], answers: str = "") -> DataFrame:
    """``pairs`` (judge, claim, context, ...) with ``said``, by each judge's own function, which is made once a task.

    ``answers``, or the session's setting, names a folder of what judges have
    said before, by judge, model, prompt, claim and context.
    """
    if path := answers or store.folder(pairs, "judged"):
        who = F.create_map(*[x for j in judges for x in (F.lit(j.name), F.lit(f"{j.model} {j.prompt_hash}"))])
        key = store.key_of(F.col("judge"), F.element_at(who, F.col("judge")), F.col("claim"), F.col("context"))
        return store.through(pairs, key, path, lambda todo: _said(todo, judges))
    return _said(pairs, judges)


def _said(pairs: DataFrame, judges: list[Judge]) -> DataFrame:
    from pyspark.sql import types as ST

    makers = {j.name: j.connect for j in judges if j.connect}
    names = [*pairs.columns, "said"]
    at = {c: i for i, c in enumerate(names)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Callable[[str, str], str]] = {}
        for b in batches:
            said = []
            for name, claim, context in zip(*(b.column(at[c]).to_pylist() for c in ("judge", "claim", "context")), strict=True):
                if name not in made:
                    made[name] = makers[name]()
                said.append(made[name](claim, context))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names)

    return pairs.mapInArrow(run, ST.StructType([*pairs.schema.fields, ST.StructField("said", ST.StringType())]))


def verdicts(claims: DataFrame, judges: list[Judge], guard: bool = True) -> DataFrame:
    """``claims`` (query_id, claim_idx, claim, context, family) with judge and verdict.

    A judge of the answer's own family does not judge it, unless none else would.
    """
    spark = claims.sparkSession
    who = spark.createDataFrame([(j.name, j.family, j.connect is not None) for j in judges], "judge string, judge_family string, _model boolean")
    pairs = claims.crossJoin(F.broadcast(who))  # the judges are a stated list
    if guard:
        own = F.coalesce(F.col("judge_family") == F.col("family"), F.lit(False))
        others = [j.family for j in judges]
        all_own = F.coalesce(F.forall(F.array(*map(F.lit, others)), lambda f: f == F.col("family")), F.lit(False))
        pairs = pairs.where(~own | all_own)
    by_rule = pairs.where("not _model").withColumn("verdict", dummy_verdict(F.col("claim"), F.col("context")))
    if any(j.connect for j in judges):
        said = judged_by_model(pairs.where("_model"), judges)
        by_rule = by_rule.unionByName(said.withColumn("verdict", parse_verdict(F.col("said"))).drop("said"))
    return by_rule.drop("_model")


def faithfulness(answers: DataFrame, contexts: DataFrame, judges: list[Judge]) -> DataFrame:
    """``query_id, seed, faithfulness``: the share of an answer's claims that most judges support; null without text, context or claims."""
    key = [c for c in ("query_id", "seed") if c in answers.columns]
    family = F.col("family") if "family" in answers.columns else F.lit(None).cast("string")
    split = answers.select(*key, family.alias("family"), F.posexplode(T.atomic_claims(F.coalesce(F.col("text"), F.lit("")))).alias("claim_idx", "claim"))
    judged = verdicts(split.join(contexts, "query_id"), judges)
    counts = judged.groupBy(*key, "claim_idx").agg(F.count_if(F.col("verdict") == "supported").alias("s"), F.count_if(F.col("verdict") == "refuted").alias("r"), F.count(F.lit(1)).alias("n"))
    share = counts.groupBy(*key).agg(F.avg((majority(F.col("s"), F.col("r"), F.col("n")) == "supported").cast("double")).alias("faithfulness"))
    return answers.select(*key).join(share, key, "left")


def prompt_hash(template: str = CLAIM_PROMPT) -> str:
    import hashlib

    return "sha256:" + hashlib.sha256(template.encode()).hexdigest()


def model_judge(name: str, family: str, model: str, connect: Callable[[], Callable]) -> Judge:
    """A judge by a language model: ``connect`` makes a client of (prompt, options), as generators use them."""

    def asked() -> Callable[[str, str], str]:
        client = connect()
        options = {"model": model, "temperature": 0.0, "max_tokens": 8, "seed": 0}
        return lambda claim, context: client(CLAIM_PROMPT.replace("{context}", context).replace("{claim}", claim), options)[0]

    return Judge(name, family, model, prompt_hash(), asked)


def anthropic_judge(model: str = "claude-haiku-4-5", name: str = "anthropic-A") -> Judge:
    from plumbline.operators.generate import anthropic_client

    return model_judge(name, "anthropic", model, anthropic_client)


def openai_judge(model: str = "gpt-4o-mini", name: str = "openai-B") -> Judge:
    from plumbline.operators.generate import openai_client

    return model_judge(name, "openai", model, openai_client)


#: Judges by the name under which they are asked for.
JUDGES: dict[str, Callable[[], Judge]] = {"dummy": lambda: Judge("dummy"), "anthropic": anthropic_judge, "openai": openai_judge}


def named_judges(names: str) -> list[Judge]:
    """The judges of a comma-separated list."""
    listed = [n for n in map(str.strip, names.split(",")) if n]
    unknown = [n for n in listed if n not in JUDGES]
    if unknown:
        raise ValueError(f"no such judge: {', '.join(unknown)}; there are {', '.join(JUDGES)}")
    return [JUDGES[n]() for n in listed]


def calibrate(items: DataFrame, judges: list[Judge]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every judge on every calibration item (task_family, claim, context, gold_verdict): alpha by judge, alpha by family and judge, and verdict counts."""
    from plumbline.operators.stats import calibration

    if not judges:
        raise ValueError("calibration needs a judge")
    if items.isEmpty():
        raise ValueError("calibration needs an item")
    rows = items.select("task_family", "claim", "context", "gold_verdict", F.lit(None).cast("string").alias("family"))
    return calibration(verdicts(rows, judges, guard=False))
