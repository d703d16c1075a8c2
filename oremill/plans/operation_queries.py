"""Queries on runs, experiments, outcomes, rights and lineage, and of built-in relational forms, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vocabulary import OUTCOME_KINDS, PAID_KINDS, PURPOSES, READY_OUTCOMES, RIGHT_NAMES
from ..operators import experiments, ideas, lineage, policy, reports
from ..sources import payloads
from ..sources import views as v
from ..sources.scratch import Scratch
from ..streaming import daily
from .common_sql import CLAIMS, EV, EXPERIMENTS, IDEAS, OUTCOMES, POLICY, sql_list


QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("q25_velocity", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, max(day) OVER (PARTITION BY event_type) AS last FROM d),
s AS (SELECT event_type, max(day) AS day, sum(n) FILTER (WHERE day = last) AS recent, sum(n) FILTER (WHERE day < last) AS b, count(*) FILTER (WHERE day < last) AS days FROM m GROUP BY event_type)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CAST(recent AS BIGINT) AS recent, round(CAST(b AS DOUBLE) / days, 1) AS baseline, round(recent / (CAST(b AS DOUBLE) / days), 2) AS velocity FROM s WHERE days > 0""")
def velocity(spark, sf):
    found = reports.velocity(v.table(spark, sf, "events"), "event_type", F.to_date("ts"))
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def runs(spark, sf):
    """Events as collection runs of a source, one a row; an error is a run that failed."""
    return v.table(spark, sf, "events").select(
        v.pick(v.SOURCES, F.col("user_id")).alias("source"), F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("reason"), F.floor(F.col("value")).cast("long").alias("record_count"),
    )


@query("q26_collection_summary", f"""WITH r AS (SELECT {sql_list(v.SOURCES)}[user_id % 6 + 1] AS source, event_id, ts, event_type = 'error' AS bad, props, CAST(floor(value) AS BIGINT) AS n FROM events)
SELECT source, count(*) AS runs, CAST(sum(n) AS BIGINT) AS records, CASE WHEN bool_or(bad) THEN 'error' END AS last_problem, arg_max(props, (ts, event_id)) FILTER (WHERE bad) AS last_reason FROM r GROUP BY source""")
def collection_summary(spark, sf):
    return reports.collection_summary(runs(spark, sf))


@query("q29_latest_experiment", f"WITH {EXPERIMENTS} SELECT idea_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY created_at DESC, ord DESC) AS k FROM exps) WHERE k = 1")
def latest_experiment(spark, sf):
    return reports.latest(v.experiments(spark, sf), "idea_id", "created_at", "ord").select("idea_id", "id", "status")


@query("q30_experiments_by_vertical", f"WITH {EXPERIMENTS}, {IDEAS} SELECT e.id, e.idea_id, i.vertical, strftime(e.created_at, '%Y-%m-%d') AS created FROM exps e JOIN ideas i ON e.idea_id = i.id WHERE i.vertical = 'beta' AND e.status = 'running'")
def experiments_by_vertical(spark, sf):
    idea = v.ideas_by_customer(spark, sf).select(F.col("id").alias("idea_id"), "vertical").filter("vertical = 'beta'")
    return v.experiments(spark, sf).filter("status = 'running'").join(idea, "idea_id").orderBy(F.col("created_at").desc(), "id").select("id", "idea_id", "vertical", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("q31_running_per_vertical", f"WITH {EXPERIMENTS}, {IDEAS} SELECT i.vertical, count(*) FILTER (WHERE e.status = 'draft') AS draft, count(*) FILTER (WHERE e.status = 'running') AS running, count(*) FILTER (WHERE e.status = 'stopped') AS stopped FROM exps e JOIN ideas i ON e.idea_id = i.id GROUP BY i.vertical")
def running_per_vertical(spark, sf):
    idea = v.ideas_by_customer(spark, sf).select(F.col("id").alias("idea_id"), "vertical")
    return v.experiments(spark, sf).join(idea, "idea_id").groupBy("vertical").pivot("status", ["draft", "running", "stopped"]).count().na.fill(0)


RIGHT_CASE = "CASE purpose " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in PURPOSES.items()) + " ELSE false END"


@query("q32_policy_decisions", f"""WITH {POLICY}, req AS (SELECT s.source, u.purpose FROM (SELECT source FROM pol UNION ALL SELECT 'unheard_of') s, (SELECT unnest({sql_list(PURPOSES)}) AS purpose) u)
SELECT req.source, purpose, coalesce(CASE WHEN purpose = 'COLLECT' AND NOT enabled THEN false ELSE {RIGHT_CASE} END, false) AS allowed,
  CASE WHEN enabled IS NULL THEN 'unknown source' WHEN purpose = 'COLLECT' AND NOT enabled THEN 'disabled' WHEN NOT {RIGHT_CASE} THEN 'right not granted' ELSE 'allowed' END AS reason FROM req LEFT JOIN pol ON req.source = pol.source""")
def policy_decisions(spark, sf):
    p = v.policies(spark)
    names = p.select("source").union(spark.createDataFrame([("unheard_of",)], "source string"))
    asked = names.withColumn("purpose", F.explode(F.array(*map(F.lit, PURPOSES))))
    return policy.decisions(asked, p)


@query("q33_gate_all", f"WITH {EV}, {POLICY} SELECT lang AS language, bool_and(coalesce(aggregate, false)) AS allowed, bool_and(coalesce(enabled AND store_derived, false)) AS rights_clear FROM ev LEFT JOIN pol USING (source) GROUP BY lang")
def gate_all(spark, sf):
    rows, p = v.evidence(spark, sf), v.policies(spark)
    return policy.gate_all(rows, p, "language", "AGGREGATE").join(policy.rights_clear(rows, p, "language"), "language")


@query("q34_policy_lint", f"""WITH {POLICY}, f AS (SELECT * REPLACE (enabled OR source = 'google_ads' AS enabled, external_inference OR source = 'reddit' AS external_inference) FROM pol)
SELECT source, 'enabled without the right to collect' AS problem FROM f WHERE enabled AND NOT collect_enabled UNION ALL SELECT source, 'raw payloads without a retention limit' FROM f WHERE store_raw AND retention_days IS NULL
UNION ALL SELECT source, 'external inference without authorisation' FROM f WHERE external_inference AND NOT authorised UNION ALL SELECT '', 'the registry is empty' FROM (SELECT count(*) AS n FROM f) WHERE n = 0
UNION ALL SELECT '', 'no source is enabled' FROM (SELECT count(*) FILTER (WHERE enabled) AS n FROM f) WHERE n = 0""")
def policy_lint(spark, sf):
    """The registry with two faults put in."""
    p = v.policies(spark)
    return policy.lint(p.withColumn("enabled", F.col("enabled") | (F.col("source") == "google_ads")).withColumn("external_inference", F.col("external_inference") | (F.col("source") == "reddit")))


MOVE = "((status = 'draft' AND {t} = 'running') OR (status = 'running' AND {t} = 'stopped'))"


@query("q35_lifecycle_transitions", f"WITH {EXPERIMENTS}, t AS (SELECT unnest(['draft', 'running', 'stopped']) AS target) SELECT status, target, count(*) AS n, bool_and({MOVE.format(t='target')}) AS legal FROM exps, t GROUP BY status, target")
def lifecycle_transitions(spark, sf):
    grid = v.experiments(spark, sf).withColumn("target", F.explode(F.array(*map(F.lit, ("draft", "running", "stopped")))))
    return grid.groupBy("status", "target").agg(F.count("*").alias("n"), F.bool_and(experiments.may_move(F.col("status"), F.col("target"))).alias("legal"))


@query("q36_economics_check", f"""WITH {EXPERIMENTS}, e AS (SELECT id, ord, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 7 = 1 THEN -1.0 ELSE CAST(ord % 97 AS DOUBLE) + 1 END AS price, CASE WHEN ord % 7 = 2 THEN '' ELSE 'derived' END AS provenance FROM exps),
c AS (SELECT *, round(price * 0.85 * 6, 2) AS expected, round(price * 0.85 * 6, 2) + CASE WHEN ord % 7 = 3 THEN 1 ELSE 0 END AS cap, round(price * 0.85 * 6, 2) + CASE WHEN ord % 7 = 4 THEN 5 ELSE 0 END AS spend FROM e)
SELECT id, CASE WHEN price IS NULL THEN 'no price' WHEN price <= 0 THEN 'price not finite and positive' WHEN provenance = '' THEN 'no provenance' WHEN abs(cap - expected) > 0.01 THEN 'cac_ceiling drifted' WHEN abs(spend - expected) > 0.01 THEN 'maximum_spend drifted' END AS problem FROM c""")
def economics_check(spark, sf):
    k = F.col("ord") % 7
    e = v.experiments(spark, sf).select("id", k.alias("k"), F.when(k == 0, F.lit(None)).when(k == 1, -1.0).otherwise((F.col("ord") % 97).cast("double") + 1).alias("price"), F.when(k == 2, "").otherwise("derived").alias("provenance"))
    cap = t.cac_ceiling(F.col("price"), F.lit(0.85), F.lit(6))
    extra = lambda n, by: F.when(F.col("k") == n, float(by)).otherwise(0.0)
    return e.select("id", experiments.economics_problem(F.col("price"), F.col("provenance"), F.lit(0.85), F.lit(6), cap + extra(3, 1), cap + extra(4, 5)).alias("problem"))


@query("q37_decisions", f"""WITH {EXPERIMENTS}, {OUTCOMES}, paid AS (SELECT experiment_id, bool_or(list_contains({sql_list(PAID_KINDS)}, kind)) AS paid FROM outs GROUP BY experiment_id),
d AS (SELECT id, status, ['advance', 'kill', 'iterate', 'ponder'][ord % 4 + 1] AS decision, CASE WHEN ord % 3 = 0 THEN '' ELSE priority END AS reason FROM exps),
r AS (SELECT d.*, coalesce(paid, false) AS paid, CASE decision WHEN 'iterate' THEN 'running' ELSE 'stopped' END AS target FROM d LEFT JOIN paid ON d.id = paid.experiment_id),
f AS (SELECT *, CASE WHEN decision = 'ponder' THEN 'unknown decision' WHEN status <> target AND NOT {MOVE.format(t='target')} THEN 'illegal transition' END AS refusal FROM r)
SELECT id AS experiment_id, decision, refusal, CASE WHEN refusal IS NULL THEN target ELSE status END AS new_status, CASE WHEN refusal IS NULL THEN reason END AS decision_reason, refusal IS NULL AND decision = 'advance' AND NOT paid AS unpaid_warning,
  CASE WHEN refusal IS NULL AND (decision <> 'iterate' OR reason <> '') THEN decision END AS outcome_kind FROM f""")
def decisions(spark, sf):
    e = v.experiments(spark, sf)
    asked = e.select(F.col("id").alias("experiment_id"), v.pick(("advance", "kill", "iterate", "ponder"), F.col("ord")).alias("decision"), F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("priority")).alias("reason"))
    return experiments.decide(e, v.outcomes(spark, sf), asked)


@query("q38_import_validation", f"""WITH {EXPERIMENTS}, {OUTCOMES}, i AS (SELECT id, experiment_id, ord, CASE WHEN ord % 11 = 0 THEN 'rumour' ELSE kind END AS kind, CASE ord % 9 WHEN 0 THEN '{{"broken' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{{"from": "ev_0012abcd"}}' WHEN 3 THEN '' ELSE value END AS value FROM outs),
j AS (SELECT i.*, e.status FROM i LEFT JOIN exps e ON i.experiment_id = e.id)
SELECT id, CASE WHEN NOT list_contains({sql_list(OUTCOME_KINDS)}, kind) THEN 'unknown kind' WHEN ord % 9 = 0 THEN 'value is not JSON' WHEN ord % 9 = 1 THEN 'value is not an object' WHEN ord % 9 = 2 THEN 'value carries source text'
  WHEN status IS NULL THEN 'unknown experiment' WHEN kind = 'kill' AND status = 'draft' THEN 'illegal transition' END AS refusal FROM j""")
def import_validation(spark, sf):
    k = F.col("ord") % 9
    value = F.when(k == 0, '{"broken').when(k == 1, "[1, 2]").when(k == 2, '{"from": "ev_0012abcd"}').when(k == 3, "").otherwise(F.col("value"))
    rows = v.outcomes(spark, sf).select("id", "experiment_id", F.when(F.col("ord") % 11 == 0, "rumour").otherwise(F.col("kind")).alias("kind"), value.alias("value"))
    return experiments.import_refusals(rows, v.experiments(spark, sf)).select("id", "refusal")


def children(spark, sf, rows):
    seg = ideas.segments(v.table(spark, sf, "documents").select(F.concat(F.lit("ev_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), "text"), F.col("text")).withColumnRenamed("id", "evidence_id")
    return {"segments": seg, "claims": v.claims(spark, sf)}


CHILD_SQL = """sg AS (SELECT 'ev_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS evidence_id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[\\s\\x0b]+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')), lambda s: length(s) >= 12)[1:12]) AS n FROM documents),
cn AS (SELECT evidence_id, count(*) AS n FROM claims GROUP BY evidence_id)"""


@query("q39_retention_purge", f"""WITH {EV}, {CLAIMS}, {POLICY}, {CHILD_SQL}, gone AS (SELECT ev.id, source FROM ev JOIN pol USING (source) WHERE fetched_at < DATE '2024-07-25' - to_days(CAST(retention_days AS INT)))
SELECT source, count(*) AS deleted, CAST(sum(coalesce(sg.n, 0)) AS BIGINT) AS affected_segments, CAST(sum(coalesce(cn.n, 0)) AS BIGINT) AS affected_claims, 'retention' AS reason FROM gone LEFT JOIN sg ON gone.id = sg.evidence_id LEFT JOIN cn ON gone.id = cn.evidence_id GROUP BY source""")
def retention_purge(spark, sf):
    rows = v.evidence(spark, sf)
    gone = lineage.expired(rows, v.policies(spark), F.lit("2024-07-25").cast("date"))
    counts, _ = lineage.delete(gone, children(spark, sf, rows))
    return lineage.audit(gone, counts, "retention")


@query("q40_upstream_deletion", f"""WITH {EV}, {CLAIMS}, gone AS (SELECT id, source FROM ev WHERE source IN ('reddit', 'youtube') AND canonical_url LIKE '%/en/1')
SELECT (SELECT count(*) FROM gone) AS deleted, (SELECT count(*) FROM claims WHERE evidence_id IN (SELECT id FROM gone)) AS claims_gone, (SELECT count(*) FROM claims WHERE evidence_id NOT IN (SELECT id FROM gone)) AS claims_left""")
def upstream_deletion(spark, sf):
    notices = spark.createDataFrame([(s, "https://example.com/en/1") for s in ("reddit", "youtube")], "source string, canonical_url string")
    gone = lineage.withdrawn(v.evidence(spark, sf), notices)
    claims = v.claims(spark, sf)
    _, left = lineage.delete(gone, {"claims": claims})
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(gone, "deleted").join(n(claims, "all")).join(n(left["claims"], "claims_left")).select("deleted", (F.col("all") - F.col("claims_left")).alias("claims_gone"), "claims_left")  # one-row totals


GRAMS = """dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM documents), bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, p AS pa, array_to_string(w[p:p + 6], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 5)) AS p FROM dw WHERE len(w) >= 7)), bg AS (SELECT item_id, p AS pb, array_to_string(w[p:p + 6], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 5)) AS p FROM bw WHERE len(w) >= 7)),
met AS (SELECT doc_id, item_id, pa, pb, gram FROM dg JOIN bg USING (gram))"""


def grams(spark, sf):
    return lineage.word_grams(v.table(spark, sf, "documents"), "doc_id", F.col("text")), lineage.word_grams(v.table(spark, sf, "benchmark"), "item_id", F.col("text"))


@query("q41_redisplay_7gram", f"WITH {GRAMS} SELECT doc_id, item_id, count(DISTINCT gram) AS shared FROM met GROUP BY doc_id, item_id")
def redisplay(spark, sf):
    a, b = grams(spark, sf)
    each = lambda df, key: df.select(key, "gram").distinct()
    return each(lineage.may_share(a, b), "doc_id").join(each(b, "item_id"), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("q42_longest_ngram", f"""WITH {GRAMS}, r AS (SELECT *, pa - row_number() OVER (PARTITION BY doc_id, item_id, pa - pb ORDER BY pa) AS run FROM met), n AS (SELECT doc_id, item_id, count(*) + 6 AS l FROM r GROUP BY doc_id, item_id, pa - pb, run)
SELECT doc_id, item_id, max(l) AS longest, (SELECT arg_min(gram, pa) FROM met m WHERE m.doc_id = n.doc_id AND m.item_id = n.item_id) AS span FROM n GROUP BY doc_id, item_id""")
def longest_ngram(spark, sf):
    a, b = grams(spark, sf)
    return lineage.with_span(lineage.shared_runs(a, b, "doc_id", "item_id"), v.table(spark, sf, "documents"), "doc_id", F.col("text")).drop("at")


@query("q43_missing_lineage", f"WITH {CLAIMS}, {EV} SELECT DISTINCT evidence_id AS id FROM claims WHERE evidence_id NOT IN (SELECT id FROM ev WHERE lang <> 'de')")
def missing_lineage(spark, sf):
    return lineage.missing(v.claims(spark, sf).select(F.col("evidence_id").alias("id")), v.evidence(spark, sf).filter("language <> 'de'"))


DECISION = "CASE o_orderpriority WHEN '1-URGENT' THEN 'advance' WHEN '2-HIGH' THEN 'iterate' WHEN '5-LOW' THEN 'kill' END"


def decided(spark, sf):
    d = F.when(F.col("priority") == "1-URGENT", "advance").when(F.col("priority") == "2-HIGH", "iterate").when(F.col("priority") == "5-LOW", "kill")
    return v.experiments(spark, sf).withColumn("decision", d)


@query("q44_calibration_dataset", f"""WITH {OUTCOMES}, e AS (SELECT 'exp_' || o_orderkey AS id, 'idea_' || o_custkey AS idea_id, o_orderdate AS created_at, {DECISION} AS decision FROM orders),
o AS (SELECT idea_id, count(DISTINCT outs.id) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e LEFT JOIN outs ON outs.experiment_id = e.id GROUP BY idea_id),
l AS (SELECT idea_id, arg_max(decision, (created_at, id)) FILTER (WHERE decision IS NOT NULL) AS decision FROM e GROUP BY idea_id)
SELECT 'idea_' || c_custkey AS idea_id, coalesce(n, 0) AS outcomes, coalesce(kinds, '') AS kinds, decision, coalesce(n, 0) >= {READY_OUTCOMES} AS ready FROM customer LEFT JOIN o ON o.idea_id = 'idea_' || c_custkey LEFT JOIN l ON l.idea_id = 'idea_' || c_custkey""")
def calibration_dataset(spark, sf):
    snaps = v.ideas_by_customer(spark, sf).select(F.col("id").alias("idea_id"))
    rows = experiments.calibration_rows(snaps, decided(spark, sf), v.outcomes(spark, sf))
    return rows.select("idea_id", "outcomes", F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"), "decision", experiments.ready(F.col("outcomes")).alias("ready"))


FIT = ("n_chars", "commas", "stops", "distinct_share")


def fit_rows(spark, sf):
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    d = v.table(spark, sf, "documents").select("doc_id", F.log(F.col("n_chars") + 1).alias("n_chars"), (F.length(F.regexp_replace("text", "[^,]", "")) / F.length("text")).alias("commas"), (F.length(F.regexp_replace("text", "[^.]", "")) / F.length("text")).alias("stops"), (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"))
    labels = v.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return experiments.encoded(d.join(labels, "doc_id").withColumn("decision", F.when(F.col("quality") == 1, "advance").otherwise("kill")))


@query("q45_feature_standardise", """WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), d AS (SELECT ln(n_chars + 1) AS n_chars, length(regexp_replace(text, '[^,]', '', 'g')) / CAST(length(text) AS DOUBLE) AS commas, length(regexp_replace(text, '[^.]', '', 'g')) / CAST(length(text) AS DOUBLE) AS stops,
  len(list_distinct(string_split(lower(text), ' '))) / CAST(len(string_split(lower(text), ' ')) AS DOUBLE) AS distinct_share FROM documents JOIN l USING (doc_id))
SELECT 'n_chars' AS feature, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std FROM d UNION ALL SELECT 'commas', round(avg(commas), 6), round(stddev_pop(commas), 6) FROM d
UNION ALL SELECT 'stops', round(avg(stops), 6), round(stddev_pop(stops), 6) FROM d UNION ALL SELECT 'distinct_share', round(avg(distinct_share), 6), round(stddev_pop(distinct_share), 6) FROM d""")
def feature_standardise(spark, sf):
    return experiments.moments(fit_rows(spark, sf), FIT).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("q46_logistic_fit")
def logistic_fit(spark, sf):
    model = experiments.fit_logistic(fit_rows(spark, sf), FIT)
    return spark.createDataFrame([(f, round(w, 6)) for f, w in [*model["weights"].items(), ("intercept", model["intercept"])]], "feature string, weight double").orderBy(F.abs("weight").desc(), "feature")


@query("q47_rescore_review", f"""WITH {EXPERIMENTS}, s AS (SELECT idea_id, status, priority, row_number() OVER (PARTITION BY idea_id ORDER BY created_at DESC, ord DESC) AS k FROM exps)
SELECT idea_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'stopped' ELSE status END AS status, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 'reviewed' ELSE priority END AS priority, c_mktsegment = 'BUILDING' AS touched FROM s JOIN customer ON idea_id = 'idea_' || c_custkey WHERE k = 1""")
def rescore_review(spark, sf):
    c = v.table(spark, sf, "customer")
    changes = c.filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("idea_"), "c_custkey").alias("idea_id"), F.lit("stopped").alias("status"), F.when(F.col("c_acctbal") > 0, "reviewed").alias("priority"))
    snaps = v.experiments(spark, sf).withColumn("created_at", F.struct("created_at", "ord"))
    return experiments.rescore(snaps, changes, "idea_id", ["status", "priority"]).select("idea_id", "status", "priority", F.coalesce("touched", F.lit(False)).alias("touched"))


@query("q48_query_merge", """WITH s AS (SELECT p_name AS text, p_partkey AS ord, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS norm FROM part WHERE p_size < 10), e AS (SELECT upper(p_name) AS text, p_partkey AS ord, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS norm FROM part)
SELECT text, ord, CAST(0 AS INT) AS origin FROM s UNION ALL SELECT text, ord, 1 FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY ord) AS k FROM e WHERE norm NOT IN (SELECT norm FROM s)) WHERE k = 1""")
def query_merge(spark, sf):
    p = v.table(spark, sf, "part")
    return payloads.effective_queries(p.filter("p_size < 10").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("ord")), p.select(F.upper("p_name").alias("text"), F.col("p_partkey").alias("ord")))


@query("q49_outcome_export", f"WITH {OUTCOMES} SELECT id AS outcome_id, experiment_id, kind, value, strftime(observed_at, '%Y-%m-%dT%H:%M:%S') AS observed_at FROM outs")
def outcome_export(spark, sf):
    """Written as CSV and read back."""
    path = f"{Scratch(spark, 'outcome_export').root}/csv"
    payloads.export_outcomes(v.outcomes(spark, sf), path)
    return spark.read.schema("outcome_id string, experiment_id string, kind string, value string, observed_at string").option("header", True).option("escape", "\\").csv(path)


@query("q50_query_source_grid", f"SELECT p_brand AS query, source FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest({sql_list(v.SOURCES)}) AS source)")
def query_source_grid(spark, sf):
    return policy.query_grid(v.table(spark, sf, "part").select(F.col("p_brand").alias("query")).distinct(), spark, list(v.SOURCES))


@query("q51_rollup_outcomes", f"WITH {OUTCOMES} SELECT kind, CAST(observed_at AS DATE)::VARCHAR AS day, count(*) AS n, CAST(grouping(kind) * 2 + grouping(CAST(observed_at AS DATE)) AS INT) AS level FROM outs GROUP BY ROLLUP (kind, CAST(observed_at AS DATE))")
def rollup_outcomes(spark, sf):
    return v.outcomes(spark, sf).withColumn("day", F.date_format("observed_at", "yyyy-MM-dd")).rollup("kind", "day").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query("q52_setops_sources", "SELECT source, 'all' AS side FROM (SELECT source FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents WHERE lang = 'de') UNION ALL SELECT source, 'only' FROM (SELECT source FROM documents WHERE lang = 'fr' EXCEPT SELECT source FROM documents WHERE lang = 'es')")
def setops_sources(spark, sf):
    of = lambda lang: v.table(spark, sf, "documents").filter(F.col("lang") == lang).select("source")
    return of("fr").intersect(of("de")).withColumn("side", F.lit("all")).unionByName(of("fr").subtract(of("es")).withColumn("side", F.lit("only")))


@query("q53_rank_windows", """SELECT c_custkey, CAST(rank() OVER w AS INT) AS rnk, CAST(dense_rank() OVER w AS INT) AS dense, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS quarter, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS before,
  count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
def rank_windows(spark, sf):
    by = Window.partitionBy("c_nationkey")
    rank, exact = by.orderBy("c_mktsegment"), by.orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return v.table(spark, sf, "customer").select(
        "c_custkey", F.rank().over(rank).alias("rnk"), F.dense_rank().over(rank).alias("dense"), F.ntile(4).over(exact).alias("quarter"), F.lag("c_custkey").over(exact).alias("before"), F.count("*").over(exact.rowsBetween(-2, 0)).alias("near")
    )


@query("q54_stream_daily", "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily(spark, sf):
    """The events table read as a stream until nothing is left."""
    scratch = Scratch(spark, "stream_daily")
    held = scratch.put(v.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    stream = spark.readStream.schema(held.schema).parquet(f"{scratch.root}/1")
    found = daily.run_available(daily.daily_counts(stream, "ts", "event_type"), scratch, "daily")
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("q55_policy_snapshot", f"WITH {EV}, {POLICY} SELECT id, {', '.join(f'coalesce({n}, false) AS {n}' for n in RIGHT_NAMES)} FROM ev LEFT JOIN pol USING (source)")
def policy_snapshot(spark, sf):
    rows, p = v.evidence(spark, sf).select("id", "source"), v.policies(spark)
    snap = F.broadcast(p.select("source", policy.snapshot(p, F.col("source")).alias("r")))
    return rows.join(snap, "source", "left").select("id", *[F.coalesce(f"r.{n}", F.lit(False)).alias(n) for n in RIGHT_NAMES])


@query("q56_lineage_counts", f"WITH {EV}, {CLAIMS}, {CHILD_SQL} SELECT ev.id AS evidence_id, coalesce(sg.n, 0) AS affected_segments, coalesce(cn.n, 0) AS affected_claims FROM ev LEFT JOIN sg ON ev.id = sg.evidence_id LEFT JOIN cn ON ev.id = cn.evidence_id")
def lineage_counts(spark, sf):
    rows = v.evidence(spark, sf)
    return lineage.delete(rows, children(spark, sf, rows))[0]


@query("q57_last_claims", f"WITH {CLAIMS} SELECT evidence_id, ord, persona FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY ord DESC) AS k FROM claims) WHERE k = 1")
def last_claims(spark, sf):
    return ideas.last_claims(v.claims(spark, sf)).select("evidence_id", "ord", "persona")


@query("q58_competitor_top", f"WITH {CLAIMS} SELECT brand AS name, count(*) FILTER (WHERE claim_type = 'switching') AS switching_count, count(*) AS mention_count FROM (SELECT lower(trim(brand)) AS brand, claim_type FROM claims) GROUP BY 1 ORDER BY 2 DESC, 3 DESC LIMIT 8")
def competitor_top(spark, sf):
    """The eight most left incumbents: a report of that size."""
    return reports.competitor_map(v.claims(spark, sf)).limit(8).select("name", "switching_count", "mention_count")
