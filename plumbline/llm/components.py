"""Connected components of a table of links, without collecting any of them to the driver.

Every round replaces the links by links from each node's neighbours to the
smallest of them (first over larger neighbours, then over smaller ones), until
a round changes nothing: each component is then a star around its smallest
node.  The number of rounds grows with the logarithm of a component's size.
Rounds are cut off from each other by checkpoints in the shared folder.

A hub, with more links than one node in ``HUBS`` has on average, gets its
smallest neighbour by a broadcast: there are ``HUBS`` hubs at most whatever the
input, and their links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import checkpointed


#: Nodes that are broadcast at most, and links that a node may have without being one of them.
HUBS, FEW = 10_000, 200


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (a, b) that isn't the smallest of its component; ``root`` is that one."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    state, n = None, edges.count()
    while True:
        # larger neighbours go to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # 2 n ends are dealt to nodes, so fewer than HUBS nodes have more than 2 n / HUBS of them
        most = max(FEW, -(-2 * n // HUBS))
        low = checkpointed(low)
        hubs = F.broadcast(low.where(F.col("n") > most).select("a", "m"))
        others = both.join(hubs, "a", "left_anti").join(low.select("a", "m"), "a")
        large = both.join(hubs, "a").unionByName(others).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # smaller ones, and the node itself, to the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, n = tuple(now), now[0]
