"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.common import store

MAX_ROUNDS = 100  # contraction needs a number of rounds that grows with the logarithm of the longest path


def components(edges: DataFrame) -> DataFrame:
    """Node and smallest node that it reaches, for every node of ``edges`` (a long, b long).

    Each round first hangs the larger neighbours of every node on the smallest one around it, then
    the smaller ones; both keep what is connected connected.  It ends when a round changes nothing,
    told by the number and a hash sum of the edges.  Loops and repeated edges do no harm; an empty
    table gives no rows.  Rounds are written to the shared folder, so that lineage stays short.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """pairs: (u, v) with every neighbour v of u that takes part."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(low, "u")
        moved = joined.where(F.col("v") > F.col("u")).select("v", "m") if larger else joined.select("v", "m").union(low.select("u", "m"))
        return moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first())

    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True)
        large = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = store(star(large, False), "edges")
        new = mark(now)
        if new == known:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        known = new
    raise RuntimeError("components did not settle")
