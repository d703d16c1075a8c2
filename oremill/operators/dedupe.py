"""Exact, near and semantic duplicates of evidence rows, each later row linked to the row that stays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: Column, order: Column, name: str = "original") -> DataFrame:
    """The id of the first row with an equal key; rows without a key (null or empty) are their own.

    Firsts are found by a map-side minimum and met in a join, so copies of one key, however many, are not sorted in one
    task; `rows` is read twice and should be a stored table without long columns.
    """
    made = rows.withColumn("__key", F.when(key != "", key))
    firsts = made.filter("__key IS NOT NULL").groupBy("__key").agg(F.min_by("id", order).alias("__first")).withColumnRenamed("__key", "__key2")
    return made.join(firsts, F.col("__key") == F.col("__key2"), "left").withColumn(name, F.coalesce("__first", "id")).drop("__key", "__key2", "__first")


def duplicates(rows: DataFrame) -> DataFrame:
    """`rows` (id, ord, content_hash, near_key_hash) with is_duplicate_of and dedupe_stage: exact first, then near among the rest.

    Later rows link to the first row of their hash even if that is itself a near duplicate.
    """
    exact = first_of(rows, F.col("content_hash"), F.col("ord"), "exact_of")
    alive = F.col("exact_of") == F.col("id")
    near = first_of(exact.withColumn("__near", F.when(alive, F.col("near_key_hash"))), F.col("__near"), F.col("ord"), "near_of").drop("__near")
    stage = F.when(~alive, "exact").when(F.col("near_of") != F.col("id"), "near")
    link = F.when(~alive, F.col("exact_of")).when(F.col("near_of") != F.col("id"), F.col("near_of"))
    return near.withColumn("is_duplicate_of", link).withColumn("dedupe_stage", stage).drop("exact_of", "near_of")


def originals(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_duplicate_of").isNull())


def pair_list(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_duplicate_of").isNotNull()).select(F.col("dedupe_stage").alias("stage"), F.col("id").alias("duplicate"), F.col("is_duplicate_of").alias("original"))


# ---------------------------------------------------------------- vectors
TILE = 2048


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def similar_pairs(rows: DataFrame, threshold: float, block: str | None = None, tile: int = TILE) -> DataFrame:
    """Pairs (a < b by ord) of rows (ord, embedding[, block]) of cosine >= threshold, by matrix products of tiles.

    Rows are dealt to tiles of about `tile` rows by a hash; every unordered pair of tiles of a block is one unit of work,
    so no task holds more than two tiles.  Only pairs over the threshold leave a unit.
    """
    kept = rows.filter(F.size("embedding") > 0).select("ord", "embedding", (F.col(block) if block else F.lit("")).alias("block"))
    most = kept.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // tile))
    tiled = kept.withColumn("tile", F.pmod(F.xxhash64("ord"), F.lit(parts)).cast("int"))
    pair = lambda other: F.struct(F.least("tile", other).alias("x"), F.greatest("tile", other).alias("y"))
    units = tiled.withColumn("unit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), pair)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["unit"].iloc[0]["x"], pdf["unit"].iloc[0]["y"]
        left, right = pdf[pdf["tile"] == x], pdf[pdf["tile"] == y]
        out = []
        for size in sorted(set(map(len, left["embedding"])) & set(map(len, right["embedding"]))):
            a, b = left[left["embedding"].map(len) == size], right[right["embedding"].map(len) == size]
            cos = _unit(a["embedding"]) @ _unit(b["embedding"]).T
            i, j = np.nonzero(cos >= threshold)
            p, q = a["ord"].to_numpy()[i], b["ord"].to_numpy()[j]
            keep = p < q if x == y else np.ones(len(p), bool)
            out.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "cos": cos[i, j][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cos": []})

    return units.groupBy("block", "unit").applyInPandas(compare, "a long, b long, cos double")


def leader_scan(rows: DataFrame, threshold: float, block: str) -> DataFrame:
    """Sequential leaders within a block: (ord, leader, cos); a row joins its best leader (the earliest of equals) or leads.

    One task a block, for blocks that fit one; `leaders_by_rounds` gives the same links without that bound.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        unit, ords, out, lead = _unit(pdf["embedding"]), pdf["ord"].to_numpy(), [], []
        for i in range(len(pdf)):
            cos = unit[lead] @ unit[i] if lead else np.zeros(0)
            best = int(cos.argmax()) if len(cos) else -1
            if best >= 0 and cos[best] >= threshold and cos[best] > 0:
                out.append((ords[i], ords[lead[best]], cos[best]))
            else:
                lead.append(i)
                out.append((ords[i], ords[i], 1.0))
        return pd.DataFrame(out, columns=["ord", "leader", "cos"])

    return rows.filter(F.size("embedding") > 0).select("ord", "embedding", block).groupBy(block).applyInPandas(scan, "ord long, leader long, cos double")


def leaders_by_rounds(pairs: DataFrame, checkpoint=lambda df: df.checkpoint()) -> DataFrame:
    """The links of `leader_scan` from all similar pairs: (duplicate, leader, cos).

    A row leads if no earlier neighbour does.  Each round settles the rows all of whose earlier neighbours are settled
    or that have a leading one; rows without pairs lead and are not listed.
    """
    nodes = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()
    state = checkpoint(nodes.join(pairs.groupBy(F.col("b").alias("n")).agg(F.lit(True).alias("later")), "n", "left").select("n", F.when(F.col("later").isNull(), "L").alias("s")))
    while state.filter("s IS NULL").limit(1).count():
        seen = pairs.join(state.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a").groupBy(F.col("b").alias("n")).agg(F.bool_or(F.col("sa") == "L").alias("led"), F.bool_and(F.coalesce(F.col("sa") == "D", F.lit(False))).alias("free"))
        state = checkpoint(state.join(seen, "n", "left").select("n", F.coalesce("s", F.when(F.coalesce("led", F.lit(False)), "D").when(F.col("free"), "L")).alias("s")))
    lead = state.filter("s = 'L'").select(F.col("n").alias("a"))
    best = pairs.join(lead, "a").groupBy("b").agg(F.max_by("a", F.struct("cos", -F.col("a"))).alias("leader"), F.max("cos").alias("cos"))
    return best.join(state.filter("s = 'D'").select(F.col("n").alias("b")), "b").select(F.col("b").alias("duplicate"), "leader", "cos")
