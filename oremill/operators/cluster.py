"""Greedy clustering by centroid and cluster labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_tokens
from .density import density_clusters


def greedy_clusters(rows: DataFrame, threshold: float, block: str) -> DataFrame:
    """(block, ord, cluster): rows in order join the cluster with the most similar sum of vectors (the earliest of equals) if
    that reaches the threshold, else found one; rows without a vector stay alone.  Order-dependent, so one task a block."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        first = next((v for v in pdf["embedding"] if v is not None and len(v)), None)
        sums = np.zeros((len(pdf), len(first) if first is not None else 1))
        out, k = [], 0
        for v in pdf["embedding"]:
            v = np.asarray(v if v is not None else [], float)
            norm = np.linalg.norm(v) if len(v) else 0.0
            best = -1
            if norm and k:
                lengths = np.linalg.norm(sums[:k], axis=1)
                cos = np.divide(sums[:k] @ v, lengths * norm, out=np.zeros(k), where=lengths > 0)
                best = int(cos.argmax()) if cos.max() >= threshold and cos.max() > 0 else -1
            if best < 0:
                best, k = k, k + 1
            if norm:
                sums[best] += v
            out.append(best)
        return pd.DataFrame({block: pdf[block], "ord": pdf["ord"], "cluster": out})

    kind = dict(rows.dtypes)[block]
    return rows.select(block, "ord", "embedding").groupBy(block).applyInPandas(scan, f"{block} {kind}, ord long, cluster long")


DENSE_FROM = 40


def clusters(rows: DataFrame, threshold: float, block: str, dense: bool = False) -> DataFrame:
    """(block, ord, cluster): greedy clusters; where `dense`, density clusters of blocks of DENSE_FROM rows or more that all
    have vectors, noise staying alone, and greedy ones of the others.  Blocks of fewer than two rows are left out.
    """
    size = rows.groupBy(block).agg(F.count("*").alias("n"), F.count_if(F.size("embedding") > 0).alias("v")).filter("n > 1")
    if not dense:
        return greedy_clusters(rows.join(size.select(block), block, "left_semi"), threshold, block)
    thick = (F.col("n") >= DENSE_FROM) & (F.col("v") == F.col("n"))
    of = lambda cond: rows.join(size.filter(cond).select(block), block, "left_semi")
    return density_clusters(of(thick), block).drop("noise").unionByName(greedy_clusters(of(~thick), threshold, block))


def groups(clustered: DataFrame, block: str, least: int = 2, most: int = 10) -> DataFrame:
    """Clusters of `least` rows or more with their members, the `most` largest of each block, earlier ones first among equals."""
    g = clustered.groupBy(block, "cluster").agg(F.count("*").alias("members"), F.min("ord").alias("first_ord")).filter(F.col("members") >= least)
    w = Window.partitionBy(block).orderBy(F.col("members").desc(), "first_ord")
    return g.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def mode_by(rows: DataFrame, key: str, value: Column, order: Column, k: int = 1) -> DataFrame:
    """The k most frequent non-empty values of each key, first seen first among equals: (key, value, n, place)."""
    counted = rows.select(F.col(key), value.alias("value"), order.alias("o")).filter(F.coalesce(F.col("value") != "", F.lit(False))).groupBy(key, "value").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "o", "value")
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("o")


def modes(rows: DataFrame, key: str, columns: list[str], order: Column) -> DataFrame:
    """One row a key with the most frequent non-empty value of each column, first seen first among equals: one pass for all."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("value")) for c in columns]))
    counted = rows.select(key, order.alias("o"), each.alias("e")).select(key, "o", "e.c", "e.value").filter("value <> ''").groupBy(key, "c", "value").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    best = counted.groupBy(key, "c").agg(F.max_by("value", F.struct("n", -F.col("o"))).alias("value"))
    return best.groupBy(key).pivot("c", columns).agg(F.first("value"))


def labels(rows: DataFrame, key: str) -> DataFrame:
    """(key, label): the three most frequent title words and the most frequent intent; rows: ord, title, intent_labels."""
    each = lambda c: rows.select(key, "ord", F.posexplode(c).alias("pos", "value"))
    words = mode_by(each(label_tokens(F.col("title"))), key, F.col("value"), F.struct("ord", "pos"), 3)
    top = words.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]), " ").alias("words"))
    intent = mode_by(each(F.col("intent_labels")), key, F.col("value"), F.struct("ord", "pos")).select(key, F.col("value").alias("intent"))
    tag = F.concat(F.lit("["), F.coalesce("intent", F.lit("unlabeled")), F.lit("]"))
    return rows.select(key).distinct().join(top, key, "left").join(intent, key, "left").select(key, F.concat_ws(" ", "words", tag).alias("label"))
