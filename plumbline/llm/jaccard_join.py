"""N-gram Jaccard self-join by a MinHash LSH forest.

Every text has a set of shingles of five words, and a signature of min-hashes
dealt to trees.  In each tree the signatures' labels are a sorted prefix trie:
texts below one node of it have a prefix in common.  Each text starts with its
longest prefix in every tree and shortens one after the other, always the one
that meets the fewest more texts (in steps of ``MANY``) for what it adds to the
recall, until a text at the threshold would meet it in some tree with the
target recall.  Nothing is
capped: at ``least`` min-hashes in all trees every text has the recall.  A pair
is a candidate where either text's prefix reaches the other.  Candidates are
verified by the exact Jaccard similarity of their shingle sets.

Work and memory: texts with the same shingles are one node, so copies never
meet each other.  Trees carry a trunk (a hash of the shortest prefix), a twig
(the min-hashes that follow) and the node's number; texts that are alone in
their trunk leave the trie at once, and how many stand below a prefix is added
up before the shuffle.  Shingles go only to nodes of the trie with two texts at
least, and to one of those that hold the same texts.  Such a group is dealt out
in square blocks of at most ``BLOCK`` by ``BLOCK`` texts, each verified by a
product of incidence matrices in one task; pairs are never written.  What
leaves a block are the number of links of each text (a pair counts in the first
tree where it meets) and a spanning forest of the block's links.  A group of g
different texts costs g * g / BLOCK rows of shingles.

Defined cases: null and empty texts have no shingles and are linked to
nothing, not even to each other; a text with 1 to 4 words has one shingle of
all its words; repeated rows are rows of their own in the result, in one class;
a class is named by its smallest doc_id (null ids only if there are no others);
rows with a null doc_id and the same shingles share one class; a table without
rows gives none.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import shared
from plumbline.llm import words as W
from plumbline.llm.components import components

#: Texts on each side of a block that is verified at once.
BLOCK = 256
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 512, dtype=np.uint64) | np.uint64(1)


#: Texts that a shorter prefix meets, below which it costs nothing.
MANY = 64
#: Bits of each min-hash of a twig.
_TWIG = 20


@dataclass(frozen=True)
class Forest:
    """``trees`` labels of ``deepest`` min-hashes each; prefixes are shortened until ``recall`` at ``threshold``."""

    width: int = 5
    threshold: float = 0.8
    recall: float = 0.9995
    trees: int = 12
    deepest: int = 5

    @property
    def least(self) -> int:
        """The longest prefix at which all trees together reach the target recall."""
        for d in range(self.deepest, 1, -1):
            if 1 - (1 - self.threshold**d) ** self.trees >= self.recall:
                return d
        return 1

    def depths(self, below: np.ndarray) -> np.ndarray:
        """Prefix lengths of each text (row) in each tree.

        below: how many texts share its prefix of each length from ``least`` to ``deepest`` (last axis), itself among them.
        """
        miss = np.log1p(-(self.threshold ** np.arange(self.least, self.deepest + 1)))
        depth = np.full(below.shape[:2], self.deepest - self.least)
        every = np.arange(self.trees)
        while True:
            short = np.flatnonzero(miss[depth].sum(axis=1) > np.log(1 - self.recall))
            short = short[depth[short].any(axis=1)]
            if not len(short):
                return depth + self.least
            at = depth[short]
            one_less = np.maximum(at - 1, 0)
            # a few texts more or less must not count: a tree where a text meets its one match would be left for those where it is alone
            more = (below[short[:, None], every, one_less] - below[short[:, None], every, at]) // MANY
            cost = np.where(at > 0, (more + 1e-3) / np.maximum(miss[at] - miss[one_less], 1e-12), np.inf)
            depth[short, cost.argmin(axis=1)] -= 1


def shingles(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, last row, and each row's distinct shingle hashes, sorted, with their offsets."""
    data, first, last = W.buffers(column)
    for i, j in W.blocks(first, last):
        words = W.Words(data, first[i:j], last[i:j])
        h, at = W.window_hashes(words.hashes(), words.of, width)
        row = np.repeat(np.arange(j - i), np.diff(at))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield i, j, h, np.searchsorted(row, np.arange(j - i + 1))


def labels(h: np.ndarray, at: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """For each row with shingles and each tree, the trunk and the twig of its label."""
    some = np.flatnonzero(np.diff(at) > 0)
    begin = at[some]
    trunk, twig = np.zeros((2, len(some), forest.trees), np.uint64)
    for t in range(forest.trees if len(some) else 0):
        trunk[:, t] = t + 1
        for k in range(forest.deepest):
            x = h * _SEEDS[t * 8 + k]
            low = np.minimum.reduceat(x ^ (x >> np.uint64(29)), begin)
            if k < forest.least:
                trunk[:, t] = W.mix(trunk[:, t] * np.uint64(0x9E3779B97F4A7C15) + low)
            else:
                twig[:, t] = twig[:, t] << np.uint64(_TWIG) | W.mix(low) >> np.uint64(64 - _TWIG)
    return trunk, twig


def node_numbers(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's set of shingles, and whether it has any."""
    n = np.diff(at)
    has = n > 0
    node = np.zeros(len(n), np.uint64)
    if has.any():
        node[has] = W.mix(np.add.reduceat(W.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][has]) + n[has].astype(np.uint64))
    return node.view(np.int64), has


def signed(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, t, node, trunks, twigs`` of each row: a hash of its text, a number for its set of shingles (null: none) and its labels."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in shingles(batch.column(2), forest.width):
                node, has = node_numbers(h, at)
                full = np.zeros(j - i + 1, np.int32)
                full[1:] = np.cumsum(has * forest.trees)
                lists = [pa.ListArray.from_arrays(pa.array(full), pa.array(x.ravel().view(np.int64))) for x in labels(h, at, forest)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(node, mask=~has), *lists], ["doc_id", "t", "node", "trunks", "twigs"])
        W.give_back(True)

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(sign, f"doc_id {kind}, t bigint, node bigint, trunks array<bigint>, twigs array<bigint>")


def _chosen(sizes: DataFrame, forest: Forest) -> DataFrame:
    """``node, depths`` from ``node`` and ``below``: structs of tree and sizes of its prefixes; in other trees a text is alone."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            known = lists.flatten()
            below = np.ones((batch.num_rows, forest.trees, forest.deepest - forest.least + 1), np.int64)
            below[of, known.field(0).to_numpy()] = np.stack([known.field(k).to_numpy() for k in range(1, known.type.num_fields)], axis=1)
            depth = forest.depths(below)
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * forest.trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(depth.ravel().astype(np.int32)))], ["node", "depths"])

    return sizes.mapInArrow(make, "node bigint, depths array<int>")


def meeting_places(nodes: DataFrame, forest: Forest) -> DataFrame:
    """``node, tree, key``: the node of each tree's trie below which a text is compared, where it isn't alone."""
    lengths = range(forest.least, forest.deepest + 1)
    prefix = [["tree", "trunk", *[f"twig{d}" for d in lengths if forest.least < d <= n]] for n in lengths]
    leaves = nodes.select("node", F.posexplode(F.arrays_zip("trunks", "twigs")).alias("tree", "x"))
    cut = [F.shiftrightunsigned("x.twigs", _TWIG * (forest.deepest - d)).bitwiseAND(F.lit((1 << _TWIG) - 1)).cast("int").alias(f"twig{d}") for d in lengths if d > forest.least]
    leaves = leaves.select("node", "tree", F.col("x.trunks").alias("trunk"), *cut)
    met = leaves.groupBy("tree", "trunk").agg(F.count(F.lit(1)).alias("n0")).where("n0 > 1")
    leaves = shared.written(leaves.join(met, ["tree", "trunk"]), "leaves")
    # texts below each prefix: added up from the longest to the shortest
    sums = [leaves.groupBy(*prefix[-1]).agg(F.count(F.lit(1)).alias(f"n{len(prefix) - 1}"))]
    for k in range(len(prefix) - 2, 0, -1):
        sums.insert(0, sums[0].groupBy(*prefix[k]).agg(F.sum(f"n{k + 1}").alias(f"n{k}")))
    sized = leaves
    for k, own in enumerate(sums, 1):
        sized = sized.join(own, prefix[k])
    below = sized.groupBy("node").agg(F.collect_list(F.struct("tree", *[f"n{k}" for k in range(len(prefix))])).alias("below"))
    asked = shared.written(leaves.drop("n0").join(_chosen(below, forest), "node").withColumn("depth", F.get("depths", F.col("tree"))).drop("depths"), "depths")
    # a trie is cut where the shortest prefix asked for below a node ends there
    least = [asked.groupBy(*prefix[-1]).agg(F.min("depth").alias(f"d{len(prefix) - 1}"))]
    for k in range(len(prefix) - 2, -1, -1):
        least.insert(0, least[0].groupBy(*prefix[k]).agg(F.min(f"d{k + 1}").alias(f"d{k}")))
    cuts = least[-1]
    for k in range(len(prefix) - 2, -1, -1):
        cuts = cuts.join(least[k], prefix[k])
    key = F.coalesce(*[F.when(F.col(f"d{k}") <= n, F.xxhash64(F.lit(n), *prefix[k])) for k, n in enumerate(lengths)])
    return asked.join(cuts.select(*prefix[-1], key.alias("key")), prefix[-1]).select("node", "tree", "key")


def sets_of(rows: DataFrame, forest: Forest) -> DataFrame:
    """``node, shingles`` from ``rows`` (node, text): the set as bytes, of rows whose text has that set."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, h, at in shingles(batch.column(1), forest.width):
                node, has = node_numbers(h, at)
                good = np.flatnonzero(has & (node == asked[i:j]))
                yield pa.RecordBatch.from_arrays([pa.array(node[good]), pa.array([h[at[r] : at[r + 1]].tobytes() for r in good.tolist()], pa.binary())], ["node", "shingles"])
        W.give_back(True)

    return rows.select("node", "text").mapInArrow(make, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def linked(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Whether each of the first ``split`` sets and each of the others are similar; all of them with each other if ``split`` is 0."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    _, number = np.unique(every, return_inverse=True)
    width = int(number.max()) + 1 if len(number) else 0
    row = np.repeat(np.arange(len(sets)), sizes)
    a, b = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    shared_ = np.zeros((len(sizes[a]), len(sizes[b])), np.float32)
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    step = 1 << 12
    for lo in range(0, width, step):
        i, j = np.searchsorted(number, [lo, lo + step])
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[row[i:j], number[i:j] - lo] = 1
        shared_ += m[a] @ m[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - shared_
    return shared_ >= threshold * union - 1e-6


def forest_of(link: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what the links of a block join."""
    root = np.arange(link.shape[0])

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(link.shape[0]):
        for j in np.flatnonzero(link[i]).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def verifier(forest: Forest):
    """The function that verifies one block: rows of (side, node, copies, keys, shingles) to links and counts."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["i"].iloc[0] != rows["j"].iloc[0] and rows["side"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)  # the other side of the block has no texts
        rows = rows.sort_values(["side", "node"])
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        split = int((rows["side"] == 0).sum()) if (rows["side"] == 1).any() else 0
        link = linked(sets, split, forest.threshold)
        if not split:
            np.fill_diagonal(link, False)
        keys, tree = np.stack(rows["keys"].to_numpy()), int(rows["tree"].iloc[0])
        ka, kb = (keys[:split], keys[split:]) if split else (keys, keys)
        once = link.copy()
        for t in range(tree):
            once &= ka[:, t][:, None] != kb[:, t][None, :]
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        if split:
            counts = np.concatenate([once @ copies[split:], once.T @ copies[:split]])
            whole = np.zeros((len(node), len(node)), bool)
            whole[:split, split:] = link
        else:
            counts, whole = once @ copies, np.triu(link)
        pairs = forest_of(whole)
        a, b = [node[i] for i, _ in pairs], [node[j] for _, j in pairs]
        return pd.DataFrame({"a": np.concatenate([node, np.array(a, np.int64)]), "b": np.concatenate([node, np.array(b, np.int64)]), "n": np.concatenate([counts, np.zeros(len(a), np.int64)]).astype(np.int64)})

    return verify


def similar(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row of ``docs`` (doc_id, text).

    ``class_id``: the smallest doc_id of the documents that links join, directly
    or through others.  ``n_links``: other documents that are similar to this
    one, copies with the same shingles among them.
    """
    forest = forest or Forest()
    rows = shared.written(signed(docs, forest), "signed")
    ids = rows.select("doc_id", "node")
    last = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(last).alias("m"), F.count(F.lit(1)).alias("copies"), F.first("trunks").alias("trunks"), F.first("twigs").alias("twigs"))
    nodes = shared.written(nodes.select("node", F.col("m.doc_id").alias("least"), F.col("m.t").alias("t"), "copies", "trunks", "twigs"), "nodes")
    places = shared.written(meeting_places(nodes, forest), "places")
    groups = places.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("m > 1")
    # of the groups that hold the same texts, the one in the first tree
    groups = groups.groupBy("m", "members").agg(F.min(F.struct("tree", "key")).alias("g")).select("g.*", "m")
    split = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    member = (
        places.join(groups, ["tree", "key"])
        .withColumn("cuts", split)
        .withColumn("cut", F.pmod(F.xxhash64("node", "tree"), F.col("cuts")).cast("int"))
        .select("tree", "key", "node", "cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        .select("tree", "key", "node", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), (F.col("cut") > F.col("other")).cast("int").alias("side"))
    )
    member = shared.checkpointed(member)
    # where a text is alone in a tree its own number stands for the place
    keys = places.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("at"))
    keys = keys.select("node", F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.coalesce(F.element_at("at", t), F.col("node"))).alias("keys"))
    wanted = nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("_least"), F.col("t").alias("_t"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    sets = sets_of(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("t") == F.col("_t"))), forest)
    sets = sets.join(nodes.select("node", "copies"), "node").join(keys, "node")
    blocks = member.join(sets, "node")
    found = blocks.groupBy("tree", "key", "i", "j").applyInPandas(verifier(forest), "a bigint, b bigint, n bigint")
    found = shared.written(found, "links")
    root = components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    known = nodes.select("node", "least", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    known = shared.written(known, "known")
    names = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(names, "root").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return ids.join(known, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_node(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with ``__node``, the number of the text's set of shingles."""
    names = [*docs.columns, "__node"]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in shingles(batch.column(batch.num_columns - 1), forest.width):
                node, has = node_numbers(h, at)
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), pa.array(node, mask=~has)], names)

    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType())]))


def one_of_each(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """The rows of ``docs``, of each class of similar texts the one with the smallest doc_id alone.

    Texts without words are similar to nothing and all stay.  If several rows of
    a class have its smallest doc_id, one of them stays.
    """
    forest = forest or Forest()
    classes = shared.written(similar(docs, forest), "classes")
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__stay"))
    kept = docs.join(stay.distinct(), F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi")
    # of a doc_id that occurs twice one row may head a class and the other not, so all rows are asked
    if classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return kept
    # doc_ids that occur twice do not name a row: there the number of its shingles does
    nodes = _with_node(docs, forest)
    roots = components_of(nodes.where("__node is not null"), forest)
    ranked = nodes.join(roots, "__node", "left").withColumn("__rank", F.row_number().over(Window.partitionBy("__root").orderBy(F.col("doc_id").asc_nulls_last(), "__node")))
    return ranked.where("__root is null or __rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def components_of(nodes: DataFrame, forest: Forest) -> DataFrame:
    """``__node, __root`` of the texts of ``nodes`` (__node, text), by the join itself with the node as the document's number."""
    found = similar(nodes.select(F.col("__node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), forest)
    return found.select(F.col("doc_id").alias("__node"), F.col("class_id").alias("__root"))
