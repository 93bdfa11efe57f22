"""Connected components of a link table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: columns a and b (longs, no nulls). Returns id, component: the smallest id that links reach.

    Large-star hangs each node's larger neighbours on its smallest neighbour, small-star the smaller ones; rounds go on
    until every node hangs on its component's smallest. Minima are aggregated before they are shuffled, and each round
    is a table in the shared folder, so that neither a hub nor a lost executor costs more than its rows."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(star, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a")
        star = down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = scratch.keep(star, "small")
        scratch.drop(edges, large)
        edges = small
        # A fixed point keeps the table's digest.
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
