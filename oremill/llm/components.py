"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """`edges` (u, v; longs) to (node, root): root is the smallest node reachable; only nodes with an edge occur.

    Each round hands the larger neighbours of a node to its smallest one (large star), then the smaller ones (small
    star).  Minima are aggregated before the shuffle and hubs meet their minimum in an ordinary join, which adaptive
    execution splits; every round is written out, so the plan stays short and a lost executor costs one round.
    """
    e = scratch.put(f"{name}0", edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    state, k = None, 0
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.put(f"{name}{k + 1}", large)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = (
            large.join(low, F.col("u") == F.col("x"))
            .filter("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        e = scratch.put(f"{name}{k + 2}", small)
        scratch.drop(f"{name}{k}", f"{name}{k + 1}")
        k += 2
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
