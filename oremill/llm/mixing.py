"""Mixing sources to target weights by weighted fair queueing.

Native: DataFrame functions only.  Documents of a source are put in a pseudo-random order, twice over (two epochs).
Each gets a virtual finish time, the words of its source up to and with it divided by the source's target; the mix
takes documents in the order of finish times, all sources together, up to the total budget.

Rows alike in doc_id, source and size (and, where asked, text) are counted first and stand in the queue as one group, one
behind the other, so that no number of copies or of missing ids meets in one task; groups become rows again by chunks.
Prefix sums over a source are taken in two steps, over buckets of the order key, as many as the rows ask for, and inside
each bucket; the cut is found by a histogram of finish times whose cutting bin is divided again until it holds no more
than EXACT rows, and by the exact order inside that: no task holds a whole source, or a share of it that grows.

Defined results: null text has size 0; documents without a source form the last source; rows that repeat a doc_id are
documents of their own; where there are no words every target is 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, narrowed

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
BINS = 1 << 14
EXACT = 1 << 16
BUCKET_ROWS = 1 << 16
CHUNK_ROWS = 1 << 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares by weight of budget x all words, none above most x its source.

    A source is at its limit iff the share left by all sources with a smaller limit-to-weight ratio reaches it.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)) + 1).cast("long"))
    ranked = weighted.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    held = ranked.withColumn("full", left * F.col("weight") >= F.col("limit") * weight_left)
    free = lambda c: F.sum(F.when(~F.col("full"), F.col(c)).otherwise(0)).over(every)
    rest = F.lit(budget) * F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(every)
    share = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(rest * F.col("weight") / free("weight"))
    return held.select("source", "source_size", share.alias("target"))


def each_row(groups: DataFrame) -> DataFrame:
    """A row for each of the n rows of a group, numbered by `nth`; large groups are spread over tasks by chunks."""
    single = groups.filter("n = 1").withColumn("nth", F.lit(0).cast("long"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_ROWS)))
    spread = groups.filter("n > 1").withColumn("chunk", chunk).repartition("doc_id", "size", "chunk")
    first = F.col("chunk") * CHUNK_ROWS
    several = spread.withColumn("nth", F.explode(F.sequence(first, F.least(first + CHUNK_ROWS, "n") - 1))).drop("chunk")
    return single.unionByName(several)


def plan_mix(sized: DataFrame, scratch: Scratch, seed: str = "mix", budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """`sized` (doc_id, source, size[, digest]; a table) with source_size, target, finish of each epoch, copies and taken, in
    queue order; `nth` of `n` numbers rows alike in all columns of `sized`."""
    goal = scratch.put("goal", targets(sized, budget=budget, most=most))
    alike = [c for c in ("doc_id", "source", "size", "digest") if c in sized.columns]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), "size"))
    key = F.md5(F.concat(F.lit(seed), name, *[F.concat(F.lit(":"), "digest") for c in alike if c == "digest"]))
    digits, rows = 3, sized.count()
    while rows >> 4 * digits > BUCKET_ROWS:
        digits += 1
    keyed = sized.groupBy(*alike).agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("size"))
    keyed = scratch.put("keyed", keyed.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits)))
    inner = Window.partitionBy("source", "bucket").orderBy("key", *[c for c in alike if c != "source"]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source", "bucket")
        .agg(F.sum("words").alias("sum"))
        .select("source", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
        .join(goal.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2")))
        .select(F.col("source").alias("source2"), F.col("bucket").alias("bucket2"), "offset", "source_size", "target")
    )
    groups = (
        keyed.withColumn("inner", F.coalesce(F.sum("words").over(inner), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("source2")) & (F.col("bucket") == F.col("bucket2")))
        .select(*alike, "n", (F.col("offset") + F.col("inner")).alias("before"), "source_size", "target")
    )
    upto = F.col("before") + (F.col("nth") + 1) * F.col("size")
    finish = lambda e: F.coalesce(F.try_divide((upto + F.lit(e) * F.col("source_size")).cast("double"), "target"), F.lit(0.0))
    queued = each_row(scratch.put("groups", groups)).select(*alike, "n", "nth", "source_size", "target", *[finish(e).alias(f"finish{e + 1}") for e in range(most)])
    queued = scratch.put("queued", queued)
    times = [f"finish{e + 1}" for e in range(most)]
    each = queued.select("size", F.explode(F.array(*times)).alias("finish")).filter("size > 0")
    all_words, longest = queued.agg(F.sum("size"), F.max(times[-1])).first()
    words, low, done = int(budget * (all_words or 0)), 0.0, 0
    high, cut, strict = (longest or 0.0) * (1 + 1e-9) + 1e-300, float("inf"), True
    while True:
        # what finishes before `low` is in the mix, `done` words of it; what finishes from `high` on is not
        width = (high - low) / BINS
        span = each.filter((F.col("finish") >= low) & (F.col("finish") < high))
        bin_of = F.least(F.floor((F.col("finish") - low) / width), F.lit(BINS - 1)).cast("int")
        bins = span.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("sum"), F.count("*").alias("rows"), F.min("finish").alias("first"), F.max("finish").alias("last"))
        over = bins.withColumn("upto", F.sum("sum").over(Window.orderBy("bin"))).filter(F.col("upto") > words - done).orderBy("bin").first()
        if over is None:  # all of it is
            cut, strict = high, True
            break
        done += over["upto"] - over["sum"]
        low, high = over["first"], math.nextafter(over["last"], math.inf)
        if over["rows"] <= EXACT or over["first"] == over["last"] or width < 1e-12 * high:
            inner = each.filter((F.col("finish") >= low) & (F.col("finish") < high)).groupBy("finish").agg(F.sum("size").alias("sum"))
            last = inner.withColumn("upto", F.sum("sum").over(Window.orderBy("finish")) + done).filter(F.col("upto") <= words).agg(F.max("finish")).first()[0]
            cut, strict = (low, True) if last is None else (last, False)
            break
    inside = lambda c: (F.col(c) < F.lit(cut)) if strict else (F.col(c) <= F.lit(cut))
    copies = sum((inside(c).cast("long") for c in times), F.lit(0))
    return queued.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).orderBy("finish1", "source", "doc_id")


def size_table(docs: DataFrame, scratch: Scratch, by_text: bool = False) -> DataFrame:
    """doc_id, source, size of every row and, `by_text`, a hash of its text, so that different texts under one id stand apart."""
    digest = [F.xxhash64("text").alias("digest")] if by_text else []
    return scratch.put("sized", narrowed(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"), *digest))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document."""
    with Scratch(spark, "mixing") as scratch:
        return scratch.finish(plan_mix(size_table(load(spark, sf_dir, "documents"), scratch), scratch).select("doc_id", "size", "source_size", "target", "taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS lim, 2 * source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s),
f AS (SELECT *, (1.5 * total - coalesce(sum(lim) OVER w, 0)) * weight >= lim * (weights - coalesce(sum(weight) OVER w, 0)) AS isfull FROM r
  WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN isfull THEN CAST(lim AS DOUBLE) ELSE
  CAST(1.5 * total - sum(CASE WHEN isfull THEN lim ELSE 0 END) OVER () AS DOUBLE) * weight / sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER () END AS target FROM f),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix' || CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, source_size, target, e, coalesce(CAST(cum + e * source_size AS DOUBLE) / nullif(target, 0), 0) AS finish FROM q, (VALUES (0), (1)) v(e)),
u AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS upto FROM e WHERE size > 0),
c AS (SELECT coalesce(max(finish), -1) AS cut FROM u WHERE upto <= floor(1.5 * (SELECT sum(size) FROM d)))
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN finish <= cut THEN size ELSE 0 END) AS BIGINT) AS taken
FROM e, c GROUP BY doc_id, size, source_size, target
"""
