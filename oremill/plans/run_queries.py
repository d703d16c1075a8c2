"""Queries on the composed run, the table store, review, life cycle, artifacts and windows, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts, experiments, ideas, lineage, policy, review
from ..settings import Adapters
from ..sources import models, store
from ..sources import views as v
from ..sources.scratch import Scratch
from ..streaming import daily
from . import run
from .common_sql import CLAIMS, DUPES, EV, EXPERIMENTS, LABELLED, OUTCOMES, sql_list
from .evidence_queries import SCORE_SQL, scored_of

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- the composed run
RUN_SQL = f"""{DUPES}, og AS (SELECT * FROM dd WHERE is_duplicate_of IS NULL), cn AS (SELECT vertical, count(*) AS claims FROM og JOIN claims c ON c.evidence_id = og.id GROUP BY og.vertical),
cl AS (SELECT vertical, ord % 14 AS cluster FROM og WHERE vertical <> 'gamma'), gr AS (SELECT vertical, least(count(*), 10) AS clusters FROM (SELECT vertical, cluster FROM cl GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY vertical)"""


def whole_run(spark, sf):
    """The run over the documents, clustered by a rule in two verticals (14 groups each) and not at all in the third."""
    held = v.Stored(spark, sf, "run", hashes=True)
    clustered = held.evidence.filter("vertical <> 'gamma'").select("vertical", "ord", (F.col("ord") % 14).alias("cluster"))
    return run.analyse(held.evidence, v.claims(spark, sf).drop("vertical"), v.policies(spark), held.scratch, clustered=clustered)


@query("q60_pipeline_run", f"""WITH {CLAIMS.replace("AS vertical", "AS claim_vertical")}, {RUN_SQL.replace("SELECT vertical, count(*) AS claims", "SELECT og.vertical, count(*) AS claims")}
SELECT vertical, count(*) FILTER (WHERE is_duplicate_of IS NULL) AS originals, count(is_duplicate_of) AS duplicates, coalesce(any_value(cn.claims), 0) AS claims, coalesce(any_value(gr.clusters), 0) AS clusters,
  coalesce(any_value(gr.clusters), 1) AS hypotheses, 3 * coalesce(any_value(gr.clusters), 1) AS ideas, 'llm' AS extraction_mode FROM dd LEFT JOIN cn USING (vertical) LEFT JOIN gr USING (vertical) GROUP BY vertical""")
def pipeline_run(spark, sf):
    return whole_run(spark, sf)["counters"]


@query("q61_pipeline_members", f"""WITH {DUPES}, og AS (SELECT id, vertical, ord, CASE WHEN vertical <> 'gamma' THEN ord % 14 END AS cluster FROM dd WHERE is_duplicate_of IS NULL),
sz AS (SELECT vertical, cluster, row_number() OVER (PARTITION BY vertical ORDER BY count(*) DESC, min(ord)) AS place FROM og WHERE cluster IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT vertical || '/' || CAST(cluster AS VARCHAR) AS hyp, id FROM og JOIN sz USING (vertical, cluster) WHERE place <= 10 UNION ALL SELECT vertical || '/all', id FROM og WHERE vertical NOT IN (SELECT vertical FROM sz)""")
def pipeline_members(spark, sf):
    return whole_run(spark, sf)["members"].select("hyp", "id")


# ---------------------------------------------------------------- the table store
def held_store(spark, sf, *tables: str) -> store.Store:
    """A store with evidence, claims, runs and queries, clusters and ideas of the driver's tables."""
    s = store.Store(spark, f"{Scratch(spark, 'store').root}/tables")
    rows = {
        "evidence_event": lambda: v.evidence(spark, sf).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withColumn("is_duplicate_of", F.when(F.col("ord") % 5 == 0, F.lit("ev_x"))),
        "pain_claim": lambda: v.claims(spark, sf).withColumn("id", F.concat(F.lit("clm_"), "ord")),
        "query": lambda: spark.range(25).select(F.concat(F.lit("q_"), "id").alias("id"), v.pick(v.VERTICALS, F.col("id")).alias("vertical"), F.lit("text").alias("text")),
        "source_run": lambda: v.table(spark, sf, "events").select(F.concat(F.lit("run_"), "event_id").alias("id"), F.concat(F.lit("q_"), F.col("user_id") % 25).alias("query_id"), F.lit("ok").alias("status")),
        "cluster_member": lambda: v.table(spark, sf, "documents").select(F.concat(F.lit("cl_"), F.col("doc_id") % 7).alias("cluster_id"), F.concat(F.lit("ev_"), F.lpad((F.col("doc_id") * 2).cast("string"), 8, "0")).alias("evidence_id"), F.col("doc_id").alias("place")),
        "product_idea": lambda: v.ideas_by_customer(spark, sf).select("id", "vertical", F.col("balance").alias("score_total"), F.when(F.col("balance") > 5000, "interview").otherwise("archive").alias("band")),
    }
    for name in tables:
        s.replace(name, rows[name]())
    return s


@query("q62_evidence_scan", f"WITH {EV} SELECT id, vertical, canonical_url FROM ev WHERE vertical = 'beta' AND ord % 5 <> 0")
def evidence_scan(spark, sf):
    return store.evidence_for_vertical(held_store(spark, sf, "evidence_event"), "beta").select("id", "vertical", "canonical_url")


@query("q63_cluster_members", f"WITH {EV} SELECT ev.id, doc_id AS place FROM documents JOIN ev ON ev.id = 'ev_' || lpad(CAST(doc_id * 2 AS VARCHAR), 8, '0') WHERE doc_id % 7 = 3")
def cluster_members(spark, sf):
    return store.members(held_store(spark, sf, "evidence_event", "cluster_member"), "cl_3").select("id", "place")


@query("q64_runs_of_vertical", f"SELECT 'run_' || event_id AS id, 'q_' || (user_id % 25) AS query_id FROM events WHERE {sql_list(v.VERTICALS)}[(user_id % 25) % 3 + 1] = 'gamma'")
def runs_of_vertical(spark, sf):
    return store.runs_of(held_store(spark, sf, "query", "source_run"), "gamma").select("id", "query_id")


@query("q65_claims_of_vertical", f"WITH {CLAIMS}, {EV} SELECT 'clm_' || c.ord AS id, c.evidence_id FROM claims c JOIN ev ON ev.id = c.evidence_id WHERE ev.vertical = 'alpha'")
def claims_of_vertical(spark, sf):
    return store.claims_of(held_store(spark, sf, "evidence_event", "pain_claim"), "alpha").select("id", "evidence_id")


@query("q66_ideas_by_band", f"SELECT 'idea_' || c_custkey AS id, c_acctbal AS score_total FROM customer WHERE {sql_list(v.VERTICALS)}[c_custkey % 3 + 1] = 'beta' AND c_acctbal > 5000 ORDER BY c_acctbal DESC, id LIMIT 30")
def ideas_by_band(spark, sf):
    """The thirty best ideas of a vertical and band: a list of that length."""
    return store.ideas_by(held_store(spark, sf, "product_idea"), "beta", "interview").select("id", "score_total")


@query("q67_missing_adapters", f"SELECT p_brand AS query, source, 'error' AS status, 'no adapter registered' AS reason, 0 AS record_count FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest({sql_list(v.SOURCES)}) AS source) WHERE source <> 'searxng'")
def missing_adapters(spark, sf):
    asked = policy.query_grid(v.table(spark, sf, "part").select(F.col("p_brand").alias("query")).distinct(), spark, list(v.SOURCES))
    return Adapters({"searxng": lambda *_: None}).missing(asked)


# ---------------------------------------------------------------- life cycle and review
PRICED = """pe AS (SELECT id, ord, status, CASE WHEN ord % 5 = 0 THEN NULL ELSE CAST(ord % 90 + 10 AS DOUBLE) END AS price, 'derived' AS provenance, 0.85 AS margin, 6 AS months FROM exps),
pc AS (SELECT *, round(price * margin * months, 2) AS cap, round(price * margin * months, 2) AS spend FROM pe)"""


def priced_experiments(spark, sf):
    price = F.when(F.col("ord") % 5 != 0, (F.col("ord") % 90 + 10).cast("double"))
    rows = v.experiments(spark, sf).select("id", "ord", "status", price.alias("price"), F.lit("derived").alias("provenance"), F.lit(0.85).alias("margin"), F.lit(6).alias("months"))
    cap = F.round(F.col("price") * F.col("margin") * F.col("months"), 2)
    return rows.withColumn("cap", cap).withColumn("spend", cap)


@query("q68_start_experiments", f"""WITH {EXPERIMENTS}, {PRICED}, a AS (SELECT *, ord % 2 = 0 AS asked, CASE WHEN ord % 4 = 0 THEN 50.0 END AS own FROM pc),
r AS (SELECT *, CASE WHEN asked THEN CASE WHEN status <> 'draft' THEN 'illegal transition' WHEN coalesce(own, price) IS NULL THEN 'no price' END END AS refusal FROM a)
SELECT id, CASE WHEN asked AND refusal IS NULL THEN 'running' ELSE status END AS status, CASE WHEN asked AND refusal IS NULL THEN coalesce(own, price) ELSE price END AS price,
  CASE WHEN asked AND refusal IS NULL AND own IS NOT NULL THEN 'reviewed:operator 2024-08-01' ELSE provenance END AS provenance, CASE WHEN asked AND refusal IS NULL AND own IS NOT NULL THEN 255.0 ELSE cap END AS cap, refusal FROM r""")
def start_experiments(spark, sf):
    held = priced_experiments(spark, sf)
    asked = held.filter(F.col("ord") % 2 == 0).select("id", F.when(F.col("ord") % 4 == 0, 50.0).alias("price"))
    return experiments.started(held, asked, F.lit("2024-08-01").cast("date")).select("id", "status", "price", "provenance", "cap", "refusal")


@query("q69_stop_experiments", f"WITH {EXPERIMENTS} SELECT id, CASE WHEN ord % 3 = 0 AND status = 'running' THEN 'stopped' ELSE status END AS status, CASE WHEN ord % 3 = 0 AND status <> 'running' THEN 'illegal transition' END AS refusal FROM exps")
def stop_experiments(spark, sf):
    held = v.experiments(spark, sf)
    return experiments.stopped(held, held.filter(F.col("ord") % 3 == 0)).select("id", "status", "refusal")


@query("q70_review_edits", """SELECT 'hyp_' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) ELSE c_name END AS buyer,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'policy_ok_local_research' ELSE 'unreviewed' END AS compliance_status, c_custkey AS untouched, c_custkey % 2 = 0 AS reviewed FROM customer""")
def review_edits(spark, sf):
    """Every second hypothesis is reviewed; a null leaves its field as it was, and fields that may not be edited stay."""
    c = v.table(spark, sf, "customer")
    name = F.concat(F.lit("hyp_"), "c_custkey").alias("id")
    hyps = c.select(name, F.col("c_name").alias("buyer"), F.lit("unreviewed").alias("compliance_status"), F.col("c_custkey").alias("untouched"))
    ok = F.when(F.col("c_custkey") % 3 == 0, "policy_ok_local_research")
    edits = c.filter("c_custkey % 2 = 0").select(name, F.when(F.col("c_mktsegment") != "BUILDING", F.lower("c_mktsegment")).alias("buyer"), ok.alias("compliance_status"), F.lit(-1).alias("untouched"))
    return review.edited(hyps, edits)


@query("q71_review_rescored", f"""WITH {SCORE_SQL} SELECT vertical || '/' || form AS id, score_total, CASE WHEN total >= 80 THEN 'paid_validation' WHEN total >= 70 THEN 'interview' WHEN total >= 55 THEN 'collect_more' ELSE 'archive' END AS band
FROM (SELECT * REPLACE (total + (10 - compliance_rights) AS total, round(total + (10 - compliance_rights), 1) AS score_total) FROM scored)""")
def review_rescored(spark, sf):
    """All hypotheses cleared by a reviewer: their ideas scored again from the stored features, bands no longer held back."""
    held = scored_of(v.Stored(spark, sf, "rescored"))
    hyps = held.select("vertical", "buyer", "channel", "compliance_status").distinct().withColumnRenamed("vertical", "id")
    edits = hyps.select("id", F.lit("policy_ok_local_research").alias("compliance_status"))
    own = held.select(F.concat("vertical", F.lit("/"), "form").alias("id"), F.col("vertical").alias("hypothesis_id"), "form", "smallest_paid_test")
    values = F.create_map(*[x for f in ideas.FEATURE_NAMES for x in (F.lit(f), F.col(f).cast("double"))])
    snaps = held.select(F.lit("s").alias("id"), F.concat("vertical", F.lit("/"), "form").alias("idea_id"), values.alias("features"), F.lit(1).alias("created_at"))
    return review.rescored(review.edited(hyps, edits), own, snaps).select("id", "score_total", "band")


@query("q72_queue_top", f"""WITH {SCORE_SQL} SELECT vertical, max(score_total) AS best_score, count(*) AS ideas FROM scored GROUP BY vertical ORDER BY best_score DESC, vertical LIMIT 5""")
def queue_top(spark, sf):
    """The five hypotheses with the best scores: a report of that length."""
    held = scored_of(v.Stored(spark, sf, "queue"))
    return review.queue(held.select("vertical").distinct(), held, "vertical", 5).select("vertical", "best_score", "ideas")


@query("q73_review_pack", f"""WITH {EV}, {CLAIMS}, n AS (SELECT vertical, count(*) AS c FROM claims GROUP BY vertical), e AS (SELECT vertical, count(*) AS r FROM ev GROUP BY vertical)
SELECT vertical, kind, least(CASE kind WHEN 'claim' THEN 10 WHEN 'evidence' THEN 8 WHEN 'idea' THEN 6 WHEN 'feature' THEN 14 ELSE 1 END, CASE kind WHEN 'claim' THEN c WHEN 'evidence' THEN r ELSE 99 END) AS n
FROM e JOIN n USING (vertical), (SELECT unnest(['claim', 'evidence', 'idea', 'feature', 'awaiting']) AS kind)""")
def review_pack(spark, sf):
    held = v.Stored(spark, sf, "pack")
    return review.pack(held.evidence, held.claims, scored_of(held), "vertical").groupBy("vertical", "kind").agg(F.count("*").alias("n"))


MODEL = {"weights": {"unique_domain_count": 0.5, "claim_count": -0.25, "high_intent_share": 2.0}, "means": {"unique_domain_count": 3.0, "claim_count": 100.0, "high_intent_share": 0.1}, "stds": {"unique_domain_count": 2.0, "claim_count": 50.0, "high_intent_share": 0.2}, "intercept": 0.125}


@query("q74_score_diff", f"""WITH {SCORE_SQL}, z AS (SELECT *, greatest(-60, least(60, {MODEL["intercept"]} + {" + ".join(f"({w}) * (CAST({f} AS DOUBLE) - {MODEL['means'][f]}) / {MODEL['stds'][f]}" for f, w in MODEL["weights"].items())})) AS s FROM scored)
SELECT vertical, form, score_total, round(100 / (1 + exp(-s)), 1) AS learned, round(round(100 / (1 + exp(-s)), 1) - score_total, 6) AS difference FROM z""")
def score_diff(spark, sf):
    rows = scored_of(v.Stored(spark, sf, "diff")).drop(*ideas.dimensions(), "total", "failed_gates", "band", "awaiting_review", "score_total")
    return review.score_diff(rows, MODEL).select("vertical", "form", "score_total", "learned", F.round("difference", 6).alias("difference"))


@query("q75_decision_counts", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'advance' WHEN '2-HIGH' THEN 'iterate' WHEN '5-LOW' THEN 'kill' END AS decision, count(*) AS n FROM orders GROUP BY 1")
def decision_counts(spark, sf):
    from .operation_queries import decided

    return experiments.decision_counts(decided(spark, sf))


@query("q76_outcome_leaks", f"WITH {OUTCOMES} SELECT id FROM outs WHERE ord % 9 = 2")
def outcome_leaks(spark, sf):
    value = F.when(F.col("ord") % 9 == 2, '{"from": "ev_0012abcd"}').otherwise(F.col("value"))
    return experiments.leakage(v.outcomes(spark, sf).withColumn("value", value)).select("id")


@query("q77_cube_experiments", f"WITH {EXPERIMENTS} SELECT status, priority, count(*) AS n, CAST(grouping(status) * 2 + grouping(priority) AS INT) AS level FROM exps GROUP BY CUBE (status, priority) HAVING count(*) > 20")
def cube_experiments(spark, sf):
    return v.experiments(spark, sf).cube("status", "priority").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")).filter("n > 20")


# ---------------------------------------------------------------- artifacts and windows
@query("q78_landing_pages", """WITH p AS (SELECT 'idea_' || c_custkey AS idea_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS who, CASE WHEN c_custkey % 3 = 0 THEN 'the recurring job' ELSE c_name END AS job, '<' || c_name || '> & co' AS pain, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN '$' || CAST(c_custkey % 90 + 10 AS VARCHAR) || ' per month' END AS price FROM customer),
v AS (SELECT idea_id, 'a' AS variant, who || ': ' || job AS headline, 'No more ' || pain AS lead, price FROM p UNION ALL SELECT idea_id, 'b', 'Done with ' || pain || '?', 'It is taken care of.', price FROM p),
e AS (SELECT idea_id, variant, price, replace(replace(replace(headline, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h, replace(replace(replace(lead, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS l FROM v)
SELECT idea_id, variant, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || h || '</title></head><body><main><h1>' || h || '</h1><p class="lead">' || l || '</p>' || coalesce('<p class="price">' || price || '</p>', '')
  || '<a class="cta" href="#reserve" data-variant="' || variant || '">' || CASE WHEN price IS NULL THEN 'Tell me more' ELSE 'Reserve a place' END || '</a></main></body></html>' || chr(10) AS html FROM e""")
def landing_pages(spark, sf):
    c = v.table(spark, sf, "customer")
    idea = F.concat(F.lit("idea_"), "c_custkey").alias("idea_id")
    hyps = c.select(idea, F.lower("c_mktsegment").alias("buyer"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("job"), F.concat(F.lit("<"), "c_name", F.lit("> & co")).alias("pain"), F.lit(None).cast("string").alias("pitch"))
    drafts = c.filter("c_custkey % 2 = 0").select(idea, (F.col("c_custkey") % 90 + 10).cast("double").alias("price_monthly"), F.when(F.col("c_custkey") % 5 != 0, "derived").alias("price_provenance"))
    return artifacts.landing_html(artifacts.landing_content(hyps, drafts))


@query("q79_evidence_table", f"WITH {EV} SELECT id, replace(title[1:80], '|', '/') AS title, domain FROM ev ORDER BY ord LIMIT 20")
def evidence_table(spark, sf):
    """The first twenty rows: the table of a scaffold."""
    return artifacts.evidence_table(v.evidence(spark, sf))


@query("q80_redisplayed", """WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM documents), bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 6], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 5)) AS p FROM dw WHERE len(w) >= 7)), bg AS (SELECT item_id, p, array_to_string(w[p:p + 6], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 5)) AS p FROM bw WHERE len(w) >= 7))
SELECT item_id AS artifact, doc_id AS evidence_id, 'text' AS field, arg_min(gram, p) AS span FROM bg JOIN dg USING (gram) GROUP BY item_id, doc_id""")
def redisplayed(spark, sf):
    shown = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("artifact"), "text")
    return lineage.redisplayed(shown, v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), ["text"])


@query("q81_sliding_windows", """WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events), w AS (SELECT event_type, day - to_days(CAST(k AS INT)) AS start FROM d, (SELECT unnest(range(7)) AS k))
SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    """The events table as a stream, counted in windows of seven days that begin every day."""
    scratch = Scratch(spark, "sliding")
    held = scratch.put(v.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    stream = spark.readStream.schema(held.schema).parquet(f"{scratch.root}/1")
    found = daily.run_available(daily.sliding_counts(stream, "ts", "event_type", "7 days"), scratch, "windows")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("q82_claim_prompts", f"""WITH {EV}, r AS (SELECT vertical, row_number() OVER (PARTITION BY vertical ORDER BY ord) - 1 AS k FROM ev) SELECT vertical, CAST(floor(k / 6) AS INT) AS batch, count(*) AS lines FROM r WHERE k < 24 GROUP BY 1, 2""")
def claim_prompts(spark, sf):
    """How many rows each prompt holds; that a model reads 24 rows a run is the feature."""
    asked = models.claim_prompts(v.evidence(spark, sf), "vertical")
    return asked.select("vertical", "batch", F.size(F.regexp_extract_all("prompt", F.lit(r'(?m)^(\{"id":)'), 1)).cast("long").alias("lines"))


@query("q83_evidence_both_sides", f"""WITH {LABELLED}, {CLAIMS}, s AS (SELECT lb.vertical, lb.ord, lb.id, list_contains(intent_labels, 'anti_demand') AS a, list_has_any(intent_labels, ['problem_aware', 'feature_request', 'workaround', 'solution_aware']) OR EXISTS (SELECT 1 FROM claims c WHERE c.evidence_id = lb.id) AS p FROM lb)
SELECT vertical, row_number() OVER (PARTITION BY vertical ORDER BY a, ord) AS place, id AS evidence_id FROM s WHERE a OR p""")
def evidence_both_sides(spark, sf):
    """The evidence for a hypothesis and then that against it, numbered; a place is found by counts of buckets of the order."""
    held = v.Stored(spark, sf, "both_sides")
    return ideas.numbered_links(ideas.evidence_links(held.evidence, held.claims, "vertical"), "vertical").select("vertical", "place", "evidence_id")


@query("q84_embedding_mode", "SELECT 'with' AS rows, 'stored' AS mode UNION ALL SELECT 'without', 'none'")
def embedding_mode(spark, sf):
    vectors = v.table(spark, sf, "embeddings").select("embedding", F.lit(None).cast("string").alias("is_duplicate_of"))
    none = vectors.withColumn("embedding", F.lit(None).cast("array<double>"))
    return spark.createDataFrame([("with", store.embedding_mode(vectors)), ("without", store.embedding_mode(none))], "rows string, mode string")


@query("q85_report_ideas", f"WITH {SCORE_SQL} SELECT vertical, form, score_total FROM (SELECT *, row_number() OVER (ORDER BY score_total DESC, vertical, form_ord) AS k FROM scored) WHERE k <= 20")
def report_ideas(spark, sf):
    """The twenty best ideas: a report of that length."""
    return scored_of(v.Stored(spark, sf, "report")).orderBy(F.col("score_total").desc(), "vertical", "form_ord").limit(20).select("vertical", "form", "score_total")

