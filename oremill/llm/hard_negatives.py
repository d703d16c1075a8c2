"""Hard negatives: for every anchor and positive, the best rows of another label that score a little below the positive.

Vectors become integer vectors, so that scores are whole numbers and equal on every machine.  Anchors meet all rows in
units of work, one block of anchors and one block of rows each, so that no task holds more than two blocks whatever the
tables' size.  In a unit each anchor's scores are computed whole and sorted by score and id.  A first round takes the best
rows of the anchor's own label out of that order; they are merged over the units to its positives.  A second round finds
each positive's upper limit in the order by binary search and reads rows of other labels from there until there are enough
or the lower limit is passed; they are merged again.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part; vectors of
different lengths are never compared; a null id comes after all others and is no anchor; rows that repeat are rows of their
own; scores beyond 64 bits stop at the largest; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, narrowed

ANCHOR_BLOCK = 1024
ROW_BLOCK = 8192
#: Scores computed at a time.
SCORES = 1 << 21
EXACT = float(1 << 53)
MOST = (1 << 63) - 1


# ---------------------------------------------------------------- vectors
def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """Rows that take part (vec_id, label, embedding) with `v`, the floor of each component times `scale`."""
    x = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")
    whole = F.col("embedding").isNotNull() & F.col("label").isNotNull()
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return rows.filter(whole & ~F.coalesce(bad, F.lit(False))).select("vec_id", "label", F.transform("embedding", x).alias("v"))


def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in floating point as long as no sum can pass 2^53, else in whole numbers."""
    if a.size == 0 or b.size == 0 or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


# ---------------------------------------------------------------- one unit
def _by_length(table: pa.Table) -> dict[int, pa.Table]:
    size = pc.list_value_length(table["v"]).to_numpy(zero_copy_only=False)
    return {int(n): table.filter(pa.array(size == n)) for n in np.unique(size)}


def ordered_scores(rows: pa.Table, anchors: pa.Table, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, its rows' places by falling score and rising id, those scores): a full sort an anchor."""
    b, a = matrix(rows["v"], dim), matrix(anchors["v"], dim)
    ids = rows["vec_id"].fill_null(MOST).to_numpy()
    tie = np.lexsort((rows["uid"].to_numpy(), ids, rows["vec_id"].is_null().to_numpy()))
    place = np.empty(len(tie), np.int64)
    place[tie] = np.arange(len(tie))
    step = max(1, SCORES // max(1, len(b)))
    for at in range(0, len(a), step):
        for k, s in enumerate(scores(a[at : at + step], b)):
            order = np.lexsort((place, -s))
            yield at + k, order, s[order]


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        mine, theirs = _by_length(rows), _by_length(anchors)
        for dim in mine.keys() & theirs.keys():
            by_label = mine[dim]["label"].to_numpy()
            of = theirs[dim]["label"].to_numpy()
            for label in np.unique(of):
                r, a = mine[dim].filter(pa.array(by_label == label)), theirs[dim].filter(pa.array(of == label))
                r_uid, a_uid, ids = r["uid"].to_numpy(), a["uid"].to_numpy(), r["vec_id"].to_pylist() if len(r) else []
                for n, order, s in ordered_scores(r, a, dim) if len(r) else ():
                    head = order[: k + 1]
                    keep = np.flatnonzero(r_uid[head] != a_uid[n])[:k]
                    out += [(a_uid[n], r_uid[head[i]], ids[head[i]], s[i]) for i in keep]
        return _table(out, "a_uid uid vec_id score")

    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        mine, theirs = _by_length(rows), _by_length(anchors)
        for dim in mine.keys() & theirs.keys():
            r, a = mine[dim], theirs[dim]
            labels, uid, ids = r["label"].to_numpy(), r["uid"].to_numpy(), r["vec_id"].to_pylist()
            a_uid, a_label, limits = a["a_uid"].to_numpy(), a["label"].to_numpy(), a["positive_scores"].to_pylist()
            for n, order, s in ordered_scores(r, a, dim):
                other = labels[order] != a_label[n]
                for p in limits[n]:
                    # first place whose score is within the upper limit, and first beyond the lower one
                    first = int(np.searchsorted(-s, -(p * high // 100), side="left"))
                    stop = int(np.searchsorted(-s, -(-(-p * low // 100)), side="right"))
                    for i in _first_true(other, first, stop, k):
                        out.append((a_uid[n], p, uid[order[i]], ids[order[i]], s[i]))
        return _table(out, "a_uid positive_score uid vec_id score")

    return run


def _first_true(mask: np.ndarray, first: int, stop: int, k: int) -> list[int]:
    """The first k places in [first, stop) where the mask holds, read in growing steps."""
    found, step = [], 4 * k
    while first < stop and len(found) < k:
        found += (first + np.flatnonzero(mask[first : min(first + step, stop)])).tolist()
        first, step = first + step, step * 2
    return found[:k]


def _table(rows: list[tuple], names: str) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(names.split())
    return pa.table({n: pa.array([None if x is None else int(x) for x in c], pa.int64()) for n, c in zip(names.split(), cols)})


# ---------------------------------------------------------------- all units
def _meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, run, schema: str) -> DataFrame:
    """`run` over every pair of a block of rows and a block of anchors."""
    row_blocks, anchor_blocks = -(-n_rows // ROW_BLOCK), -(-n_anchors // ANCHOR_BLOCK)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(1, n)))
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))
    left = rows.withColumn("x", block("uid", row_blocks)).withColumn("y", grid(anchor_blocks))
    right = anchors.withColumn("y", block("a_uid", anchor_blocks)).withColumn("x", grid(row_blocks))
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(run, schema)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchor, scratch: Scratch, k: int = 5, positives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` are vec_id, label, v as `integer_vectors` gives them; `anchor` is the condition that makes a row an anchor.  A
    negative's score lies between `low` and `high` percent of the positive's.
    """
    held = scratch.put("vectors", narrowed(rows, "vec_id", "label", "v").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", F.monotonically_increasing_id().alias("uid")))
    asked = scratch.put("anchors", held.filter(anchor).select(F.col("uid").alias("a_uid"), F.col("vec_id").alias("anchor_id"), "label", "v"))
    n_rows, n_anchors = held.count(), asked.count()
    sent = asked.withColumn("uid", F.col("a_uid")).select("a_uid", "uid", "label", "v")
    found = _meet(held, sent, n_rows, n_anchors, _positives(positives), "a_uid long, uid long, vec_id long, score long")
    best = scratch.put("positives", _best(found, ["a_uid"], positives))
    limits = best.groupBy("a_uid").agg(F.sort_array(F.collect_set("score")).alias("positive_scores"))  # at most `positives` each
    sent = asked.join(limits, "a_uid").select("a_uid", "label", "v", "positive_scores")
    found = _meet(held, sent, n_rows, n_anchors, _negatives(k, low, high), "a_uid long, positive_score long, uid long, vec_id long, score long")
    kept = _best(found, ["a_uid", "positive_score"], k)
    named = best.join(asked.select("a_uid", "anchor_id"), "a_uid").select("a_uid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return kept.join(named, ["a_uid", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: anchors are rows whose vec_id is divisible by 100, against all rows."""
    rows = integer_vectors(load(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    with Scratch(spark, "hard_negatives") as scratch:
        return scratch.finish(hard_negatives(moved, F.col("vec_id") % 100 == 0, scratch))


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE alike) WHERE k <= 5),
r AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM r WHERE rank <= 5
"""
