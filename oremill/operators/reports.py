"""Aggregates that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intent_share(labelled: DataFrame) -> DataFrame:
    """intent, n and share of all rows, most frequent first."""
    total = labelled.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    n = labelled.select(F.explode("intent_labels").alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select("intent", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.col("n").desc(), "intent")  # one row of totals


def totals(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("is_duplicate_of").isNotNull()).alias("duplicates"), F.count_if(F.col("is_duplicate_of").isNull()).alias("originals"),
        F.count_distinct(F.when(F.col("is_duplicate_of").isNull(), F.nullif("domain", F.lit("")))).alias("domains"),
    )


def collection_summary(runs: DataFrame) -> DataFrame:
    """Per source: runs, records, and the status of the last run that was not ok."""
    bad = F.when(F.col("status") != "ok", F.struct("started_at", "id"))
    return runs.groupBy("source").agg(F.count("*").alias("runs"), F.sum("record_count").alias("records"), F.max_by("status", bad).alias("last_problem"), F.max_by("reason", bad).alias("last_reason"))


def velocity(rows: DataFrame, key: str, day: Column) -> DataFrame:
    """The last day's count against the mean of the earlier days that have rows; null for a single day."""
    return velocity_of(rows.groupBy(key, day.alias("day")).agg(F.count("*").alias("n")), key)


def velocity_of(daily: DataFrame, key: str) -> DataFrame:
    """`velocity` from counts (key, day, n)."""
    last = F.max("day").over(Window.partitionBy(key))
    marked = daily.withColumn("is_last", F.col("day") == last)
    sums = marked.groupBy(key).agg(F.max("day").alias("day"), F.sum(F.when(F.col("is_last"), F.col("n"))).alias("recent"), F.sum(F.when(~F.col("is_last"), F.col("n"))).alias("before"), F.count_if(~F.col("is_last")).alias("days"))
    base = F.col("before") / F.col("days")
    return sums.filter("days > 0").select(key, "day", "recent", F.round(base, 1).alias("baseline"), F.round(F.col("recent") / base, 2).alias("velocity"))


def competitor_map(claims: DataFrame) -> DataFrame:
    """Incumbents by name (case and outer space ignored): mentions, switches, their share, and what claims say, first seen first."""
    each = claims.select("ord", "claim_type", "persona", "obstacle", F.explode("incumbents").alias("b")).withColumn("name", F.lower(F.btrim("b"))).filter("name <> ''")
    seen = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("ord", c)))), lambda s: s[c]))
    sums = each.groupBy("name").agg(F.count("*").alias("mention_count"), F.count_if(F.col("claim_type") == "switching").alias("switching_count"), F.min("ord").alias("first_ord"))
    firsts = lambda c: each.filter(F.col(c) != "").groupBy("name", c).agg(F.min("ord").alias("ord")).groupBy("name").agg(seen(c).alias(f"{c}s"))
    return (
        sums.join(firsts("persona"), "name", "left").join(firsts("obstacle"), "name", "left")
        .withColumn("switching_share", F.col("switching_count") / F.col("mention_count"))
        .orderBy(F.col("switching_count").desc(), F.col("mention_count").desc(), "first_ord")
    )


def alternatives(claims: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Direct competitors, do-it-yourself workarounds and doing nothing, by key."""
    direct = claims.select(key, F.explode("incumbents").alias("b")).withColumn("name", F.lower(F.btrim("b"))).filter("name <> ''").groupBy(key).agg(F.count_distinct("name").alias("direct"))
    diy = claims.groupBy(key).agg(F.count_if(F.coalesce(F.col("current_workaround") != "", F.lit(False))).alias("workarounds"))
    idle = labelled.groupBy(key).agg(F.count_if(F.array_contains("intent_labels", "anti_demand")).alias("do_nothing"))
    return idle.join(direct, key, "full").join(diy, key, "full").na.fill(0)


def review_queue(hypotheses: DataFrame, ideas: DataFrame, key: str) -> DataFrame:
    """Hypotheses with ideas: their failed gates, best score, number of ideas and whether one waits at the interview band."""
    per = ideas.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("failed_gates")))).alias("missing_gates"), F.max("score_total").alias("best_score"), F.count("*").alias("ideas"), F.bool_or(F.col("band") == "interview").alias("awaiting")
    )
    return hypotheses.select(key).join(per, key).orderBy(F.col("best_score").desc(), key)


def evidence_pack(labelled: DataFrame, claims: DataFrame, key: str, most_claims: int = 10, most_rows: int = 8) -> DataFrame:
    """Of each key the most urgent claims and the first rows: a report, so the limits are the feature."""
    top = lambda df, order, k: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= k)
    c = top(claims, [F.col("urgency").desc(), F.col("ord")], most_claims).select(key, F.lit("claim").alias("kind"), "place", F.col("evidence_id").alias("ref"))
    e = top(labelled, [F.col("ord")], most_rows).select(key, F.lit("evidence").alias("kind"), "place", F.col("id").alias("ref"))
    return c.unionByName(e)


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def markdown(title: str, sections: dict[str, DataFrame], most: int = 20) -> str:
    """A report of small tables; each is cut to `most` rows where it is read."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(str(v).replace("|", "/") for v in row) + " |" for row in df.limit(most).collect()]
    return "\n".join(lines) + "\n"
