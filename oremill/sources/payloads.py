"""Search payloads in, evidence rows and run logs out; append, upsert and update as new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import policy as rights

PAYLOAD = "query string, source string, results array<struct<url:string,title:string,content:string,engines:array<string>,score:double,publishedDate:string>>, error string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).json(path)


LINEAGE = ("query_id", "vertical", "source_run_id")


def _lineage(rows: DataFrame) -> list[str]:
    """Columns that say where a row comes from, where it has them."""
    return [c for c in LINEAGE if c in rows.columns]


def records(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """One row a result; the limit counts results before those without a URL are dropped."""
    each = payloads.select("query", "source", *_lineage(payloads), F.posexplode(F.slice("results", 1, limit)).alias("pos", "r")).filter(F.coalesce(F.col("r.url") != "", F.lit(False)))
    return each.select(
        "query", "source", *_lineage(payloads), "pos", F.col("r.url").alias("url"), t.html_text(F.col("r.title")).alias("title"), t.html_text(F.col("r.content")).alias("snippet"),
        F.array_join(F.coalesce("r.engines", F.array().cast("array<string>")), ", ").alias("engine"), F.col("r.score").alias("score"), F.col("r.publishedDate").alias("published_at"),
    )


def batches(payloads: DataFrame, policy: DataFrame, limit: int = 10) -> DataFrame:
    """status and reason of each collection: disabled if the policy denies it, else error, empty or ok."""
    gate = rights.decisions(payloads.withColumn("purpose", F.lit("COLLECT")), policy)
    kept = F.size(F.filter(F.slice("results", 1, limit), lambda r: F.coalesce(r["url"] != "", F.lit(False))))
    status = F.when(~F.col("allowed"), "disabled").when(F.col("error").isNotNull(), "error").when(F.coalesce(kept, F.lit(0)) <= 0, "empty").otherwise("ok")
    return gate.select("query", "source", *_lineage(payloads), status.alias("status"), F.when(~F.col("allowed"), F.col("reason")).otherwise(F.col("error")).alias("reason"), F.when(status == "ok", kept).otherwise(0).alias("record_count"))


def natural_id(prefix: str, *parts: Column) -> Column:
    """A stable id from what makes a row itself, so that a second run writes the same rows."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def evidence_rows(found: DataFrame, policy: DataFrame, vertical: str | None, fetched_at: Column) -> DataFrame:
    """Rows that the policy lets be stored, with what they are compared by, their rights and the policy's version."""
    allowed = rights.decisions(found.withColumn("purpose", F.lit("STORE_DERIVED")), policy).filter("allowed").drop("allowed", "reason", "purpose")
    url = t.canonical_url(F.col("url"))
    rows = allowed.withColumn("canonical_url", url).withColumn("domain", t.host_of(url)).withColumn("content_hash", t.content_hash(url, F.col("title"), F.col("snippet")))
    version = (F.col("policy_version") if "policy_version" in policy.columns else F.lit(0)).alias("policy_version")
    p = F.broadcast(policy.select(F.col("source").alias("p_source"), rights.snapshot(policy, F.col("source")).alias("rights_profile"), version))
    return (
        rows.withColumn("near_dup_key", t.near_key(F.concat_ws(" ", "title", "snippet"))).withColumn("vertical", F.lit(vertical) if vertical else F.col("vertical")).withColumn("fetched_at", fetched_at)
        .withColumn("id", natural_id("ev", F.col("query_id" if "query_id" in found.columns else "query"), F.col("source"), F.col("pos").cast("string"), F.col("content_hash")))
        .join(p, F.col("source") == F.col("p_source")).drop("p_source")
    )


def collected(payloads: DataFrame, requests: DataFrame, adapters: list[str], policy: DataFrame, limit: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(runs, evidence rows) of `requests` (query, query_id, vertical, source) against payload rows (query, source, results, error).

    A request to a source that may not be collected is a run that is disabled, one to a source without an adapter a run that
    ended in an error, whatever payloads there are; neither gives rows, nor does a payload that failed or is empty.  Rows and
    runs know their query and each other; a payload that repeats is one run.
    """
    asked = rights.decisions(requests.withColumn("purpose", F.lit("COLLECT")), policy).drop("purpose")
    has = F.col("source").isin(*adapters) if adapters else F.lit(False)
    run_id = lambda *parts: natural_id("run", F.col("query_id"), F.col("source"), now.cast("string"), *parts)
    shape = ["source_run_id", "query_id", "vertical", "query", "source", "status", "reason", "record_count"]
    denied = asked.filter(~F.col("allowed") | ~has).withColumns({
        "status": F.when(~F.col("allowed"), "disabled").otherwise("error"), "reason": F.when(~F.col("allowed"), F.col("reason")).otherwise("no adapter registered"),
        "record_count": F.lit(0), "source_run_id": run_id(),
    })
    mine = payloads.join(asked.filter(F.col("allowed") & has).drop("allowed", "reason"), ["query", "source"])
    mine = mine.withColumn("source_run_id", run_id(F.to_json(F.struct("results", "error"))))
    runs = denied.select(*shape).unionByName(batches(mine, policy, limit).select(*shape)).dropDuplicates(["source_run_id"])
    good = F.col("error").isNull()  # of payloads that may be collected, those that failed are left out and empty ones have no rows
    return runs, evidence_rows(records(mine.filter(good), limit), policy, None, now).dropDuplicates(["id"])


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`held` and those rows of `new` whose key it lacks, the first of each."""
    one = new.dropDuplicates(keys)
    return held.unionByName(one.join(held, keys, "left_anti"), allowMissingColumns=True)


def updated(held: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A new version of `held`: columns of `changes` where they are not null."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    return held.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in cols}).drop(*[f"__{c}" for c in cols])


def effective_queries(seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """Seeds (text, ord) all, in order, then expanded ones whose normal form is neither a seed nor repeated."""
    s = seeds.select("text", "ord", F.lit(0).alias("origin"))
    e = expanded.select("text", "ord", F.lit(1).alias("origin")).withColumn("norm", t.norm_query(F.col("text")))
    new = e.join(s.select(t.norm_query(F.col("text")).alias("norm")).distinct(), "norm", "left_anti")
    first = new.withColumn("place", F.row_number().over(Window.partitionBy("norm").orderBy("ord"))).filter("place = 1")
    return s.unionByName(first.select("text", "ord", "origin"))


def sanitised(raw: DataFrame, known: DataFrame, limit: int = 10) -> DataFrame:
    """Proposed queries (text, ord): blank, over-long and known ones dropped, the first of each kept, up to the limit."""
    n = raw.withColumn("norm", t.norm_query(F.col("text"))).filter("length(norm) > 0 AND length(text) <= 80")
    n = n.join(known.select(t.norm_query(F.col("text")).alias("norm")).distinct(), "norm", "left_anti")
    first = n.withColumn("place", F.row_number().over(Window.partitionBy("norm").orderBy("ord"))).filter("place = 1")
    return first.orderBy("ord").limit(limit).select("text", "ord")


def export_outcomes(outcomes: DataFrame, path: str) -> None:
    rows = outcomes.select(F.col("id").alias("outcome_id"), "experiment_id", "kind", "value", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at"))
    rows.orderBy("observed_at", "outcome_id").write.mode("overwrite").option("header", True).csv(path)


def import_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of three columns; one with more or fewer is kept whole in `malformed`."""
    shape = "experiment_id string, kind string, value string, malformed string"
    return spark.read.schema(shape).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").csv(path)
