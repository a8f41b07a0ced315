"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.storage import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges a < b: each b and its smaller neighbours go to the least of them."""
    least = scratch.put(edges.groupBy("b").agg(F.min("a").alias("m")), name)
    moved = edges.join(least, "b")
    return moved.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node that has an edge (columns a < b); the root is the least node it reaches.

    Rounds write their edges to the shared folder and keep only the last table. The least neighbours are tables too,
    so that Spark splits their joins at hubs. The edge count and an order-free hash tell when nothing changes any more.
    No edges give no nodes.
    """
    at, now = 0, scratch.put(edges, "edges0")
    if now.isEmpty():
        return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    sign = None
    while True:
        large = scratch.put(_large_star(now, scratch, f"large{at}"), f"stars{at}")
        nxt = scratch.put(_small_star(large, scratch, f"small{at}"), f"edges{at + 1}")
        r = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.min("a")).first()
        scratch.drop(f"edges{at}", f"large{at}", f"small{at}", f"stars{at}")
        at, now = at + 1, nxt
        if tuple(r) == sign:
            break
        sign = tuple(r)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
