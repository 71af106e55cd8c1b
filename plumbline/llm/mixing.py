"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Each source has a target in words.  A document of a source is to be taken
``target / source_size`` times; the whole part is taken outright, the fraction
is its copy probability.  Two documents with fractional probabilities meet: a
random transfer moves words from one to the other, keeping both expectations
and the sum of ``size * probability``, until one of them is integral.  The
other one meets the next document.  Blocks of a bounded number of documents
are rounded in this way next to each other; the one document that each block
leaves undecided goes on to the next level, ``FAN_IN`` to a block, until a
source has a single one, which is rounded to the nearer number.  So the words
taken from a source miss its target by half of one document's words at most.
Long documents meet first, so that the last one tends to be short.

All randomness is a hash of the seed, the two documents and their place, so
reruns agree whatever the partitioning.

Defined cases: a null text has size 0, and documents of size 0 are taken 0
times (``taken`` 0); a null source is a source of its own, last in order; rows
with the same doc_id are separate documents, which may be given different
counts; a source without words has the target 0; a table without rows gives
no rows.  Other columns, whatever their names, are not read by ``mix`` and
are carried by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import checkpointed

#: Words as the operators of this subpackage take them.
WORD = r"[^\x20\x09-\x0D]+"
#: Source weights by code point order of the sources, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix to words of all documents.
BUDGET = 1.5
#: Most times that a source is repeated.
MOST = 2.0
#: Documents that meet in a block of the first level, on average, and residuals in one of a later level.
FAN_IN = 48


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``source, n, source_size, target`` from ``source, n, source_size``, one row a source.

    Targets are by weight; where a target would be above ``most`` times the
    source's size it stops there, and the excess is shared anew by weight among
    the others.  The sources that stop are the first ones by size per weight,
    so running sums over that order give the level in one pass.
    """
    names = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    asked = F.sum("source_size").over(everything) * F.lit(budget)
    cap = F.lit(most) * F.col("source_size")
    capped_before = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    marked = ranked.withColumns({"asked": asked, "cap": cap, "stops": (asked - capped_before) * F.col("w") > cap * weight_left})
    level = (F.col("asked") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("stops"), F.col("w"))).over(everything)
    return marked.select("source", "n", "source_size", F.when(F.col("stops") | (F.col("cap") == 0), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def _uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) * F.lit(2.0**-53)


def _pivotal(items: Column, seed: int, level: int) -> Column:
    """Struct of ``done`` (doc_id, size, copies) and ``rest`` (doc_id, size, p) of one block's array of (doc_id, size, p)."""

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["order"].alias("order"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"))

    def done(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.cast("int").alias("copies"))

    def step(acc: Column, x: Column) -> Column:
        # the words that can move up to the holder from the newcomer, and down
        # the other way, until one of the two probabilities is 0 or 1
        held = acc["rest"]
        hs, xs, hp, xp = (v.cast("double") for v in (held["size"], x["size"], held["p"], x["p"]))
        up_full, down_full = (1 - hp) * hs <= xp * xs, hp * hs <= (1 - xp) * xs
        up, down = F.least((1 - hp) * hs, xp * xs), F.least(hp * hs, (1 - xp) * xs)
        goes_up = _uniform(seed, F.lit(level), held["doc_id"], x["doc_id"], acc["k"], held["size"], x["size"]) * (up + down) < down
        clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        new_h = F.when(goes_up, F.when(up_full, 1.0).otherwise(clip(hp + up / hs))).otherwise(F.when(down_full, 0.0).otherwise(clip(hp - down / hs)))
        new_x = F.when(goes_up, F.when(up_full, clip(xp - up / xs)).otherwise(0.0)).otherwise(F.when(down_full, clip(xp + down / xs)).otherwise(1.0))
        settled = F.when(goes_up, up_full).otherwise(down_full)  # the holder is integral
        met = F.when(
            settled,
            F.struct(F.array_append(acc["done"], done(held, new_h)).alias("done"), item(x, new_x).alias("rest"), (acc["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.array_append(acc["done"], done(x, new_x)).alias("done"), item(held, new_h).alias("rest"), (acc["k"] + 1).alias("k")))
        return F.when((hp > 0) & (hp < 1), met).otherwise(
            F.struct(F.array_append(acc["done"], done(held, hp)).alias("done"), item(x, xp).alias("rest"), (acc["k"] + 1).alias("k"))
        )

    first = F.struct(
        F.slice(F.transform(items, lambda x: done(x, x["p"])), 1, 0).alias("done"),
        F.element_at(items, 1).alias("rest"),
        F.lit(0).alias("k"),
    )
    return F.aggregate(F.slice(items, 2, F.size(items)), first, step)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 17) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken``: one row for each row of ``docs`` (doc_id, source, text)."""
    # rows that agree in all are numbered, so that they are dealt to different blocks, the same in every run
    every = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("t")).groupBy("doc_id", "source", "size", "t").agg(F.count(F.lit(1)).alias("times"))
    sized = checkpointed(every)
    sums = sized.groupBy("source").agg(F.sum("times").alias("n"), F.sum(F.col("size") * F.col("times")).alias("source_size"))
    goals = checkpointed(targets(sums, weights, budget, most))
    largest = goals.agg(F.max("n")).first()[0] or 0
    each = (
        sized.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("r").cast("int"))
        .withColumn("p", F.col("r") - F.col("whole"))
    )
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    of = ["source", "source_size", "target", "whole"]
    result = each.where(~open_).select("doc_id", "size", *of, F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN))
    left = each.where(open_).select(
        *of, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "t", "time"), blocks_of).alias("block"), F.struct((-F.col("size")).alias("order"), "doc_id", "size", "p").alias("item"))
    level, most_blocks = 0, max(1, -(-largest // FAN_IN))
    while True:
        blocks = checkpointed(
            left.groupBy(*of, "block")
            .agg(F.array_sort(F.collect_list("item")).alias("items"))
            .select(*of, "block", _pivotal(F.col("items"), seed, level).alias("out"))
        )
        result = result.unionByName(
            blocks.select(*of, F.explode("out.done").alias("d")).select("d.doc_id", "d.size", *of, (F.col("whole") + F.col("d.copies")).alias("copies"))
        )
        if most_blocks == 1:
            break
        left = blocks.select(*of, F.floor(F.col("block") / FAN_IN).cast("long").alias("block"), F.col("out.rest").alias("item"))
        most_blocks, level = -(-most_blocks // FAN_IN), level + 1
    last = blocks.select(*of, F.col("out.rest.*")).withColumn("copies", F.col("whole") + (F.col("p") >= 0.5).cast("int"))
    result = result.unionByName(last.select("doc_id", "size", *of, "copies"))
    return result.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, **options)
    # rows that agree in doc_id, source and size share their counts out by place
    counts = taken.groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_src"), F.col("size").alias("__mix_size")).agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias("__mix_copies"))
    key = F.xxhash64("doc_id", "source", "__mix_n")
    rows = docs.withColumn("__mix_n", n_words(F.col("text"))).withColumn("__mix_key", key)
    counts = counts.withColumn("__mix_key2", F.xxhash64("__mix_id", "__mix_src", "__mix_size"))
    same = (F.col("__mix_key") == F.col("__mix_key2")) & F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_src")) & (F.col("__mix_n") == F.col("__mix_size"))
    several = counts.where(F.size("__mix_copies") > 1)
    if several.isEmpty():
        joined = rows.join(counts, same).withColumn("__mix_times", F.element_at("__mix_copies", 1))
    else:
        place = Window.partitionBy("__mix_key", "doc_id", "source", "__mix_n").orderBy(F.xxhash64("text"))
        joined = rows.withColumn("__mix_place", F.row_number().over(place)).join(counts, same).withColumn("__mix_times", F.element_at("__mix_copies", F.col("__mix_place")))
    return joined.where(F.col("__mix_times") > 0).withColumn("__mix_time", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
