"""Queries on collection through the payload source, values in force at a time, and stored daily partials; with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import asof, partials, reports
from ..sources import payload_source, payloads
from ..sources import views as v
from ..sources.scratch import Scratch
from .common_sql import EV, sql_list

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("q90_collect", f"""WITH {EV}, p AS (SELECT ord, query_id, source, CASE ord % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'error' ELSE 'ok' END AS status FROM ev WHERE source IN ('searxng', 'web_crawler', 'youtube')),
f AS (SELECT source, status, CASE WHEN status = 'error' THEN 'timed out' END AS reason, count(DISTINCT (query_id, CASE WHEN status = 'empty' THEN -1 ELSE ord END)) AS runs, count(*) FILTER (WHERE status = 'ok') AS records,
  count(*) FILTER (WHERE status = 'ok' AND source <> 'youtube') AS stored FROM p GROUP BY source, status),
q AS (SELECT count(DISTINCT query_id) AS n FROM ev)
SELECT source, status, reason, runs, records, stored FROM f UNION ALL SELECT s, 'disabled', CASE WHEN s = 'nobody' THEN 'unknown source' ELSE 'disabled' END, n, 0, 0 FROM q, (SELECT unnest(['google_ads', 'serp_provider', 'reddit', 'nobody']) AS s)
UNION ALL SELECT 'newsfeed', 'error', 'no adapter registered', n, 0, 0 FROM q""")
def collect(spark, sf):
    """Documents as payload files of their sources: three may be collected, one of them not stored; one has no files."""
    scratch = Scratch(spark, "collect")
    ev, k = v.evidence(spark, sf), F.col("ord") % 7
    one = F.struct(F.concat(F.lit("https://example.com/p/"), "ord").alias("url"), "title", F.col("snippet").alias("content"), F.array(F.lit("e")).alias("engines"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("publishedDate"))
    nameless = F.struct(F.lit("").alias("url"), "title", F.lit("").alias("content"), F.array(F.lit("e")).alias("engines"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("publishedDate"))
    made = ev.select(F.col("query_id").alias("query"), "source", F.when(k == 0, F.array().cast("array<struct<url:string,title:string,content:string,engines:array<string>,score:double,publishedDate:string>>")).otherwise(F.array(nameless, one)).alias("results"), F.when(k == 1, "timed out").alias("error"))
    made.write.partitionBy("source").json(f"{scratch.root}/payloads")
    p = v.policies(spark)
    open_too = F.col("source").isin("web_crawler", "youtube")
    p = p.withColumns({c: F.col(c) | open_too for c in ("enabled", "collect_enabled")})
    p = p.unionByName(p.filter("source = 'searxng'").withColumn("source", F.lit("newsfeed")))
    names = spark.createDataFrame([(s,) for s in (*v.SOURCES, "newsfeed", "nobody")], "source string")
    queries = ev.select("query_id").distinct().select(F.col("query_id").alias("query"), payloads.natural_id("q", F.col("query_id")).alias("query_id"), F.lit("alpha").alias("vertical"))
    raw = payload_source.read_gated(spark, f"{scratch.root}/payloads", p)
    log, found = payloads.collected(raw, queries.join(F.broadcast(names)), payload_source.folders(spark, f"{scratch.root}/payloads"), p, 10, F.lit("2024-05-01").cast("timestamp"))  # eight names
    log, found = scratch.put(log), scratch.put(found.select("source_run_id", "query_id"))
    stored = found.filter("query_id IS NOT NULL").groupBy("source_run_id").agg(F.count("*").alias("stored"))
    met = log.join(stored, "source_run_id", "left")
    return met.groupBy("source", "status", "reason").agg(F.count("*").alias("runs"), F.sum("record_count").cast("long").alias("records"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored"))


CHANGES = f"""ch AS (SELECT {sql_list(v.SOURCES)}[user_id % 6 + 1] AS source, ts, event_id, event_type <> 'error' AS enabled, CAST(floor(value) AS BIGINT) AS retention_days FROM events WHERE event_type IN ('error', 'signup', 'purchase'))"""


def policy_changes(spark, sf):
    """Events as changes of a source's policy: an error switches it off, a signup or purchase on, each with days of retention."""
    e = v.table(spark, sf, "events").filter(F.col("event_type").isin("error", "signup", "purchase"))
    return e.select(v.pick(v.SOURCES, F.col("user_id")).alias("source"), F.col("ts").cast("timestamp").alias("since"), "event_id", (F.col("event_type") != "error").alias("enabled"), F.floor("value").cast("long").alias("retention_days"))


@query("q91_rights_in_force", f"""WITH {EV}, {CHANGES}, e AS (SELECT id, source, CAST(fetched_at AS TIMESTAMP) + to_hours(CAST(ord % 24 AS INT)) AS at FROM ev), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, ts ORDER BY event_id DESC) AS k FROM ch) WHERE k = 1)
SELECT e.id, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS since, c.enabled, c.retention_days FROM e ASOF LEFT JOIN c ON e.source = c.source AND e.at >= c.ts""")
def rights_in_force(spark, sf):
    """The rights of each row's source as they stood when the row was fetched."""
    scratch = Scratch(spark, "rights_in_force")
    rows = v.evidence(spark, sf).select("id", "source", (F.col("fetched_at").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("ord") % 24).cast("int"))).alias("at"))
    met = asof.as_of(rows, policy_changes(spark, sf), ["source"], "at", "since", ["event_id", "enabled", "retention_days"], scratch.put, [F.col("event_id")])
    return met.select("id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "enabled", "retention_days")


@query("q92_decision_in_force", """WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1)
SELECT l_orderkey * 10 + l_linenumber AS line, o.o_orderkey AS last_order, o.o_orderstatus AS status FROM (SELECT l.*, c.o_custkey AS cust FROM lineitem l JOIN orders c ON l_orderkey = c.o_orderkey) x ASOF LEFT JOIN o ON x.cust = o.o_custkey AND x.l_shipdate >= o.o_orderdate""")
def decision_in_force(spark, sf):
    """The customer's latest order on the day that each line is shipped."""
    scratch = Scratch(spark, "decision_in_force")
    o = v.table(spark, sf, "orders")
    lines = v.table(spark, sf, "lineitem").join(o.select("o_orderkey", F.col("o_custkey").alias("customer")), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "customer", F.col("l_shipdate").alias("at"))
    changes = o.select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"))
    return asof.as_of(lines, changes, ["customer"], "at", "since", ["last_order", "status"], scratch.put).select("line", "last_order", "status")


def nights(spark, sf, name, partial):
    """Partials of the events, put in store by three nights of ten days, each of which reads its own days."""
    store = partials.Partials(spark, f"{Scratch(spark, name).root}/partials")
    events = v.table(spark, sf, "events")
    for first, last in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", None)):
        mine = (F.col("ts") >= F.lit(first).cast("timestamp_ntz")) if last else (F.col("ts") >= F.lit(first).cast("timestamp_ntz")) | (F.col("ts") < F.lit("2024-01-01").cast("timestamp_ntz"))
        store.put(partial(events.filter(mine & (F.col("ts") < F.lit(last).cast("timestamp_ntz")) if last else mine)))
    return store.read()


@query("q93_nightly_velocity", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, max(day) OVER (PARTITION BY event_type) AS last FROM d),
s AS (SELECT event_type, max(day) AS day, sum(n) FILTER (WHERE day = last) AS recent, sum(n) FILTER (WHERE day < last) AS b, count(*) FILTER (WHERE day < last) AS days FROM m GROUP BY event_type)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CAST(recent AS BIGINT) AS recent, round(CAST(b AS DOUBLE) / days, 1) AS baseline, round(recent / (CAST(b AS DOUBLE) / days), 2) AS velocity, true AS users_within, true AS median_within FROM s WHERE days > 0""")
def nightly_velocity(spark, sf):
    """Velocity out of stored partials, and whether merged sketches keep their bounds against the exact figures."""
    found = nights(spark, sf, "nightly_velocity", lambda rows: partials.daily(rows, F.to_date("ts"), ["event_type"], distinct=F.col("user_id"), measure=F.col("value")))
    whole = partials.merged(found, ["event_type"]).select("event_type", partials.n_distinct().alias("users"), partials.quantile(0.5).alias("median"))
    events = v.table(spark, sf, "events").join(F.broadcast(whole), "event_type")  # a row a kind of event
    exact = events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("exact"), F.max("users").alias("users"), (F.count_if(F.col("value") < F.col("median")) / F.count("value")).alias("below"), (F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("upto")
    )
    near = exact.select(
        "event_type", (F.abs(F.col("users") - F.col("exact")) <= partials.DISTINCT_ERROR * F.col("exact")).alias("users_within"),
        ((F.col("below") - 0.5 <= partials.RANK_ERROR) & (0.5 - F.col("upto") <= partials.RANK_ERROR)).alias("median_within"),
    )
    return reports.velocity_of(found.select("event_type", "day", "n"), "event_type").join(near, "event_type").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("q94_nightly_collection", f"""WITH r AS (SELECT {sql_list(v.SOURCES)}[user_id % 6 + 1] AS source, event_id, ts, event_type = 'error' AS bad, props, CAST(floor(value) AS BIGINT) AS n FROM events)
SELECT source, count(*) AS runs, CAST(sum(n) AS BIGINT) AS records, CASE WHEN bool_or(bad) THEN 'error' END AS last_problem, arg_max(props, (ts, event_id)) FILTER (WHERE bad) AS last_reason FROM r GROUP BY source""")
def nightly_collection(spark, sf):
    """The collection summary out of stored partials."""

    def partial(events):
        rows = events.select(
            v.pick(v.SOURCES, F.col("user_id")).alias("source"), F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
            F.when(F.col("event_type") == "error", F.col("props")).alias("reason"), F.floor("value").cast("long").alias("record_count"),
        )
        return partials.daily(rows, F.to_date("started_at"), ["source"], {"records": F.col("record_count")}, (F.when(F.col("status") != "ok", F.struct("started_at", "id")), F.struct("status", "reason")))

    found = partials.merged(nights(spark, sf, "nightly_collection", partial), ["source"])
    return found.select("source", F.col("n").alias("runs"), "records", F.col("newest.what.status").alias("last_problem"), F.col("newest.what.reason").alias("last_reason"))


@query("q95_price_offers", """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CAST(floor(p_retailprice) AS BIGINT) AS a, CAST(floor(p_retailprice) AS BIGINT) * 9 + l_linenumber AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT ord, 1 AS place, CAST(a AS DOUBLE) AS amount_monthly, '$' || a AS raw FROM p WHERE a <= 2500 UNION ALL SELECT ord, CASE WHEN a <= 2500 THEN 2 ELSE 1 END, round(b / 12.0, 2), '$' || b FROM p WHERE round(b / 12.0, 2) <= 2500)
SELECT ord, CAST(place AS INT) AS place, CAST(amount_monthly AS DOUBLE) AS amount_monthly, raw FROM e""")
def price_offers(spark, sf):
    """Two amounts a text, by month and by year, through the table function in SQL."""
    tables.register(spark)
    price = F.floor("p_retailprice").cast("long")
    text = F.concat(F.lit("from $"), price.cast("string"), F.lit("/mo, or $"), (price * 9 + F.col("l_linenumber")).cast("string"), F.lit(" per year when paid at once"))
    lines = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    shown = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), text.alias("signal"))
    return spark.sql("SELECT ord, place, amount_monthly, raw FROM price_offers(TABLE({shown}), 'signal')", shown=shown)
