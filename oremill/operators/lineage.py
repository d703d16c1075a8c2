"""Deletion along lineage, retention, and the guard against showing collected text again."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RedisplayError

NGRAM = 7
#: A filter of grams has this many keys at most, whatever it was made from.
FILTER_KEYS = 1 << 20


def expired(rows: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """Rows older than their source's retention, to the time of day; sources without a limit keep theirs."""
    p = F.broadcast(policy.select(F.col("source").alias("p_source"), "retention_days").filter("retention_days IS NOT NULL"))
    deadline = now.cast("timestamp") - F.make_dt_interval(F.col("retention_days"))
    return rows.join(p, F.col("source") == F.col("p_source")).filter(F.col("fetched_at").cast("timestamp") < deadline).drop("p_source")


def withdrawn(rows: DataFrame, notices: DataFrame) -> DataFrame:
    """Rows whose source withdrew their canonical_url; notices: source, canonical_url."""
    return rows.join(notices, ["source", "canonical_url"], "left_semi")


def delete(gone: DataFrame, children: dict[str, DataFrame], key: str = "evidence_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(counts of affected children by row, surviving children): rows of `gone` (id) and all that hang on them."""
    ids = gone.select(F.col("id").alias(key)).distinct()
    counts = ids
    for name, child in children.items():
        counts = counts.join(child.join(ids, key, "left_semi").groupBy(key).agg(F.count("*").alias(f"affected_{name}")), key, "left")
    return counts.na.fill(0), {name: child.join(ids, key, "left_anti") for name, child in children.items()}


def audit(gone: DataFrame, counts: DataFrame, reason: str, key: str = "evidence_id") -> DataFrame:
    """One row a source: the deleted rows and what hung on them."""
    sums = [F.sum(c).alias(c) for c in counts.columns if c.startswith("affected_")]
    met = gone.select(F.col("id").alias(key), "source").join(counts, key)
    return met.groupBy("source").agg(F.count("*").alias("deleted"), *sums).withColumn("reason", F.lit(reason))


def relinked(rows: DataFrame, gone: DataFrame, keep) -> DataFrame:
    """What is left of `rows` (id, ord, is_duplicate_of, dedupe_stage, ...) once `gone` (id) are deleted: no link leads to a deleted row.

    A row whose original goes is linked to the nearest survivor further up; where all of them go, the first of the rows that
    are left without one, by ord and id, becomes an original, and the others are linked to it.  Ways through deleted rows are
    halved each round (pointer jumping), so a chain of n takes log2(n) rounds; `keep` writes a round's table.  Links that go
    round in a ring, which no run writes, are refused.
    """
    dead = gone.select("id").distinct()
    left = rows.join(dead, "id", "left_anti")
    link = F.col("is_duplicate_of")
    above = rows.join(dead, "id", "left_semi").select("id", link.alias("to"))
    dead_to = dead.select(F.col("id").alias("to"), F.lit(True).alias("dead"))
    first = above.join(dead_to, "to", "left")
    # a way ends at a survivor (`over`), or at a deleted original (`over`, and `to` names that original as `root`)
    way = keep(first.select("id", F.coalesce("to", "id").alias("to"), F.coalesce(~F.col("dead"), F.lit(True)).alias("over"), F.col("to").isNull().alias("root")))
    before = None
    while (open_ways := way.filter("NOT over").count()) and open_ways != before:
        before = open_ways
        step = way.select(F.col("id").alias("to"), F.col("to").alias("__to"), F.col("over").alias("__over"), F.col("root").alias("__root"))
        further = way.filter("NOT over").join(step, "to").select("id", F.col("__to").alias("to"), F.col("__over").alias("over"), F.col("__root").alias("root"))
        way = keep(way.filter("over").unionByName(further))
    if open_ways:
        raise ValueError("links of duplicates go round in a ring")
    ends = way.select(F.col("id").alias("is_duplicate_of"), F.col("to").alias("__to"), F.col("root").alias("__root"))
    met = left.join(ends, "is_duplicate_of", "left")
    heirs = met.filter("__root").groupBy("__to").agg(F.min_by("id", F.struct("ord", "id")).alias("__heir"))
    led = met.join(heirs, "__to", "left")
    promoted = F.coalesce(F.col("__heir") == F.col("id"), F.lit(False))
    new_link = F.when(promoted, F.lit(None)).otherwise(F.coalesce("__heir", "__to", "is_duplicate_of"))
    return led.withColumns({"is_duplicate_of": new_link, "dedupe_stage": F.when(~promoted, F.col("dedupe_stage"))}).select(*rows.columns)


def missing(references: DataFrame, rows: DataFrame) -> DataFrame:
    """Referenced ids (id) without a row: the guard fails closed on any."""
    return references.select("id").distinct().join(rows.select("id"), "id", "left_anti")


def words_of(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_grams(texts: DataFrame, key: str, text: Column, n: int = NGRAM) -> DataFrame:
    """(key, pos, gram): n words in a row from each position (from 1), case ignored, as a pair of 64-bit hashes that stands for them."""
    held = texts.select(key, words_of(text).alias("words"))
    grams = NGram(n=n, inputCol="words", outputCol="grams").transform(held).select(key, F.posexplode("grams").alias("pos", "words"))
    return grams.select(key, (F.col("pos") + 1).alias("pos"), F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(n), "words").alias("b")).alias("gram"))


def may_share(grams: DataFrame, others: DataFrame) -> DataFrame:
    """`grams` without most of those that `others`, the smaller side, lack; none that they have is dropped.

    The filter is the distinct remainders of the hashes of `others`: no more than FILTER_KEYS numbers, so it can be sent to
    every task, and `grams` are thinned where they are made.  A gram that others lack passes by their share of all keys.
    """
    key = F.pmod(F.col("gram.a"), F.lit(FILTER_KEYS)).alias("__key")
    return grams.withColumn("__key", key).join(F.broadcast(others.select(key).distinct()), "__key", "left_semi").drop("__key")


def shared_runs(artifacts: DataFrame, sources: DataFrame, a: str, b: str, n: int = NGRAM) -> DataFrame:
    """Pairs that share n words in a row: (a, b, longest, at), the length of the longest shared stretch and where in `a` the first one begins.

    Grams meet in an equi-join of hashes, after those of the first side that the other, smaller one lacks are dropped; runs
    of consecutive positions on one diagonal give the longest shared stretch.
    """
    known = sources.select("gram").distinct()
    held = may_share(artifacts, sources).join(known, "gram", "left_semi")
    met = held.select(a, F.col("pos").alias("pa"), "gram").join(sources.select(b, F.col("pos").alias("pb"), "gram"), "gram")
    diagonal = met.withColumn("d", F.col("pa") - F.col("pb"))
    run = F.col("pa") - F.row_number().over(Window.partitionBy(a, b, "d").orderBy("pa"))
    runs = diagonal.withColumn("run", run).groupBy(a, b, "d", "run").agg((F.count("*") + n - 1).alias("longest"), F.min("pa").alias("at"))
    return runs.groupBy(a, b).agg(F.max("longest").alias("longest"), F.min("at").alias("at"))


def with_span(runs: DataFrame, texts: DataFrame, a: str, text: Column, n: int = NGRAM) -> DataFrame:
    """`runs` with the first n words that each pair shares."""
    words = texts.select(F.col(a).alias("__a"), words_of(text).alias("__words"))
    return runs.join(words, F.col(a) == F.col("__a")).withColumn("span", F.array_join(F.slice("__words", F.col("at"), n), " ")).drop("__a", "__words")


def redisplayed(artifacts: DataFrame, rows: DataFrame, fields: list[str], n: int = NGRAM) -> DataFrame:
    """(artifact, evidence_id, field, span): stretches of n words of `rows` (id, fields) that `artifacts` (artifact, text) show."""
    shown = word_grams(artifacts, "artifact", F.col("text"), n)
    each = [word_grams(rows, "id", F.col(f), n).withColumn("field", F.lit(f)) for f in fields]
    held = each[0]
    for other in each[1:]:
        held = held.unionByName(other)
    held = may_share(held, shown)
    met = shown.select("artifact", "pos", "gram").join(held.select(F.col("id").alias("evidence_id"), "field", "gram").distinct(), "gram")
    first = met.groupBy("artifact", "evidence_id", "field").agg(F.min("pos").alias("at"))
    return with_span(first, artifacts, "artifact", F.col("text"), n).drop("at")


def assert_not_redisplayed(artifacts: DataFrame, rows: DataFrame, fields: list[str], cited: DataFrame | None = None, n: int = NGRAM) -> None:
    """Raises on the first violation; fails closed where a cited id (id) has no row to be held against."""
    lost = missing(cited, rows).orderBy("id").first() if cited is not None else None
    if lost:
        raise RedisplayError(f"cited row {lost['id']} is not there")
    first = redisplayed(artifacts, rows, fields, n).orderBy("artifact", "evidence_id", "field").first()
    if first:
        raise RedisplayError(f"{first['artifact']} shows {first['evidence_id']}.{first['field']}: {first['span']!r}")
