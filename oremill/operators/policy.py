"""Default-deny rights: decisions, gates, snapshots and lint over the policy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import PURPOSES, RIGHT_NAMES


def decisions(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """`requests` (source, purpose) with allowed and reason; a source without a policy or a purpose without a right is denied."""
    p = F.broadcast(policy.select(F.col("source").alias("p_source"), "enabled", *RIGHT_NAMES))  # one row a source
    right = F.coalesce(*[F.when(F.col("purpose") == name, F.col(col)) for name, col in PURPOSES.items()], F.lit(False))
    known = F.col("p_source").isNotNull()
    off = (F.col("purpose") == "COLLECT") & ~F.col("enabled")
    met = requests.join(p, F.col("source") == F.col("p_source"), "left")
    allowed = F.coalesce(known & ~off & right, F.lit(False))
    reason = F.when(~known, "unknown source").when(off, "disabled").when(~right, "right not granted").otherwise("allowed")
    return met.select(*requests.columns, allowed.alias("allowed"), reason.alias("reason"))


def require(checked: DataFrame) -> DataFrame:
    """Fails the query on the first denied row."""
    return checked.filter(F.when(F.col("allowed"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("denied: "), "source", F.lit(" "), "purpose")).cast("boolean")))


def gate_all(rows: DataFrame, policy: DataFrame, key: str, purpose: str) -> DataFrame:
    """(key, allowed): true iff every distinct source of the key's rows may serve the purpose."""
    asked = rows.select(key, "source").distinct().withColumn("purpose", F.lit(purpose))
    return decisions(asked, policy).groupBy(key).agg(F.bool_and("allowed").alias("allowed"))


def rights_clear(rows: DataFrame, policy: DataFrame, key: str) -> DataFrame:
    p = F.broadcast(policy.select(F.col("source").alias("p_source"), "enabled", "store_derived"))
    ok = F.coalesce(F.col("enabled") & F.col("store_derived"), F.lit(False))
    return rows.select(key, "source").distinct().join(p, F.col("source") == F.col("p_source"), "left").groupBy(key).agg(F.bool_and(ok).alias("rights_clear"))


def snapshot(policy: DataFrame, source: Column) -> Column:
    return F.struct(*[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in RIGHT_NAMES])


def lint(policy: DataFrame) -> DataFrame:
    """(source, problem) rows; the empty source stands for the registry."""
    issue = lambda cond, text: policy.filter(cond).select("source", F.lit(text).alias("problem"))
    total = policy.agg(F.count("*").alias("n"), F.count_if("enabled").alias("on"))
    whole = lambda cond, text: total.filter(cond).select(F.lit("").alias("source"), F.lit(text).alias("problem"))
    return (
        issue("enabled AND NOT collect_enabled", "enabled without the right to collect")
        .unionByName(issue("store_raw AND retention_days IS NULL", "raw payloads without a retention limit"))
        .unionByName(issue("external_inference AND NOT authorised", "external inference without authorisation"))
        .unionByName(whole("n = 0", "the registry is empty"))
        .unionByName(whole("on = 0", "no source is enabled"))
    )


def sources(policy: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (policy.filter("enabled") if enabled_only else policy).orderBy("source")


def query_grid(queries: DataFrame, spark: SparkSession, names: list[str]) -> DataFrame:
    return queries.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "source string")))  # a few constant names


def version(policy: DataFrame) -> int:
    """The registry's version: 0 where it states none."""
    return int((policy.agg(F.max("policy_version")).first()[0] if "policy_version" in policy.columns else 0) or 0)
