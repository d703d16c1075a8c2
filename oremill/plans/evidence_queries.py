"""Queries on evidence, claims and ideas, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.pricing import parse_prices, price_band, priced_amounts
from ..functions.vocabulary import BANDS, FAST_FORMS, FORMS, HIGH_INTENT, STOP_WORDS, TRACKING, WEIGHTS
from ..operators import cluster, dedupe, density, ideas, policy, reports
from ..sources import views as v
from ..sources.scratch import Scratch
from .common_sql import CLAIMS, DUPES, EV, HASHED, LABELLED, POLICY, labels, quoted, sql_list

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def deduped(spark, sf, labels=False):
    return dedupe.duplicates(v.Stored(spark, sf, "dedupe", hashes=True, labels=labels).evidence)


@query("q01_intent_share", f"""WITH {DUPES}, x AS (SELECT unnest({labels("title || ' ' || snippet")}) AS intent FROM dd WHERE is_duplicate_of IS NULL)
SELECT intent, count(*) AS n, count(*) / CAST((SELECT count(*) FROM dd WHERE is_duplicate_of IS NULL) AS DOUBLE) AS share FROM x GROUP BY intent""")
def intent_share(spark, sf):
    originals = dedupe.originals(deduped(spark, sf, labels=True)).select("id", "intent_labels")
    return reports.intent_share(Scratch(spark, "intent_share").put(originals))


@query("q02_canonical_domain", f"""
WITH u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)', 1)), '^www\\.', '') AS domain,
  lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: contains(x, '=') AND split_part(x, '=', 1) <> '' AND split_part(x, '=', 2) <> '' AND NOT list_contains({sql_list(TRACKING)}, split_part(x, '=', 1)))) AS kept FROM u)
SELECT page_id, scheme || '://' || domain || CASE WHEN p = '' THEN '/' WHEN length(p) > 1 THEN coalesce(nullif(regexp_replace(p, '/+$', ''), ''), '/') ELSE p END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url, domain FROM k""")
def canonical_domain(spark, sf):
    url = t.canonical_url(F.col("url"))
    return v.table(spark, sf, "pages").select("page_id", url.alias("canonical_url"), t.host_of(F.col("url")).alias("domain"))


#: Ways in which collected URLs are odd, around the host of a page: its number decides which.
ODD_URLS = (
    ("http://user:pw@WWW.", ":8080/a b/?b=x%20y&a=1+2#top"), ("//", "/p//?q=caf%C3%A9&utm_source=z&q=a"), ("", "/no scheme?x=1&x=0"),
    ("HTTPS://", "/%7Eme/?z=a=b&y=100%25&k=&~t=*&j"), ("  https://", "/list?tags=a,b|c d&a.b=1 "), ("ftp://", "?only=query/with/slashes"), ("https://", " /blank?u=1%2B1"),
)


@query("q96_odd_urls", f"""
WITH u AS (SELECT page_id, trim({sql_list([a for a, _ in ODD_URLS])}[page_id % 7 + 1] || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\\.', '') || {sql_list([b for _, b in ODD_URLS])}[page_id % 7 + 1]) AS url FROM pages),
f AS (SELECT page_id, split_part(url, '#', 1) AS url FROM u),
g AS (SELECT page_id, CASE WHEN regexp_matches(url, '^[a-zA-Z]+:') THEN lower(split_part(url, ':', 1)) ELSE 'https' END AS scheme, regexp_replace(url, '^[a-zA-Z]+:', '') AS rest FROM f),
h AS (SELECT page_id, scheme, CASE WHEN rest LIKE '//%' THEN regexp_extract(rest, '^//([^/?]*)', 1) ELSE '' END AS place, regexp_extract(regexp_replace(rest, '^//[^/?]*', ''), '^[^?]*') AS p, regexp_extract(rest, '\?(.*)$', 1) AS q FROM g),
k AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '=.')), lambda x: [url_decode(replace(split_part(x, '=', 1), '+', ' ')), url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' '))]),
  lambda x: NOT list_contains({sql_list(TRACKING)}, x[1]))) AS kept FROM h),
d AS (SELECT *, regexp_replace(lower(split_part(regexp_replace(place, '^.*@', ''), ':', 1)), '^www\.', '') AS domain FROM k)
SELECT page_id, domain, scheme || '://' || domain || coalesce(nullif(regexp_replace(p, '/+$', ''), ''), '/')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') ELSE '' END AS canonical_url FROM d""")
def odd_urls(spark, sf):
    """Canonical URLs and hosts of URLs with blanks, escapes, users, ports, and without a scheme."""
    pages = v.table(spark, sf, "pages")
    url = F.concat(v.pick([a for a, _ in ODD_URLS], F.col("page_id")), t.host_of(F.col("url")), v.pick([b for _, b in ODD_URLS], F.col("page_id")))
    return pages.withColumn("odd", url).select("page_id", t.host_of(F.col("odd")).alias("domain"), t.canonical_url(F.col("odd")).alias("canonical_url"))


@query("q03_content_hash", f"WITH {HASHED} SELECT id, content_hash, near_dup_key FROM hashed")
def content_hash(spark, sf):
    return v.hashed(v.evidence(spark, sf)).select("id", "content_hash", "near_dup_key")


@query("q04_exact_dedupe", f"WITH {DUPES} SELECT id, exact_of FROM dd")
def exact_dedupe(spark, sf):
    return dedupe.first_of(v.Stored(spark, sf, "exact", hashes=True, labels=False).evidence.select("id", "ord", "content_hash"), F.col("content_hash"), F.col("ord"), "exact_of").select("id", "exact_of")


@query("q05_near_dedupe", f"WITH {DUPES} SELECT dedupe_stage AS stage, id AS duplicate, is_duplicate_of AS original FROM dd WHERE is_duplicate_of IS NOT NULL")
def near_dedupe(spark, sf):
    return dedupe.pair_list(deduped(spark, sf))


@query("q06_dedupe_summary", f"""WITH {DUPES} SELECT vertical, count(*) AS total, count(is_duplicate_of) AS duplicates, count(*) - count(is_duplicate_of) AS originals,
  count(DISTINCT CASE WHEN is_duplicate_of IS NULL THEN nullif(domain, '') END) AS domains FROM dd GROUP BY vertical""")
def dedupe_summary(spark, sf):
    return reports.totals(deduped(spark, sf), "vertical")


def vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", F.col("label").cast("string").alias("label"), v.pick(v.VERTICALS, F.col("vec_id")).alias("block"))


@query("q07_semantic_pairs", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS cos FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.4""")
def semantic_pairs(spark, sf):
    return dedupe.similar_pairs(vectors(spark, sf), 0.4).select("a", "b", F.round("cos", 6).alias("cos"))


@query("q08_semantic_dedupe")
def semantic_dedupe(spark, sf):
    scratch = Scratch(spark, "semantic_dedupe")
    pairs = scratch.put(dedupe.similar_pairs(vectors(spark, sf), 0.4))
    return dedupe.leaders_by_rounds(pairs, scratch.put).select("duplicate", "leader", F.round("cos", 6).alias("cos"))


@query("q09_greedy_cluster")
def greedy_cluster(spark, sf):
    return cluster.groups(cluster.greedy_clusters(vectors(spark, sf), 0.3, "block"), "block")


@query("q97_density_clusters")
def density_clusters(spark, sf):
    """Every vector's density cluster within its block; tiles of 256 rows, so that blocks of these tables have several."""
    return density.density_clusters(vectors(spark, sf), "block", Scratch(spark, "density").put, tile=256)


@query("q98_core_distances", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT x.vec_id, round(sqrt(greatest(2 - 2 * list_cosine_similarity(x.v, y.v), 0)), 7) AS d FROM e x JOIN e y ON x.vec_id <> y.vec_id AND x.vec_id % 8 = y.vec_id % 8),
k AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS place FROM d)
SELECT vec_id AS ord, round(d, 6) AS core FROM k WHERE place = 2""")
def core_distances(spark, sf):
    """The distance to the third nearest vector, itself counted, within one of eight blocks."""
    rows = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", (F.col("vec_id") % 8).alias("block"))
    found = density.core_distances(Scratch(spark, "core").put(density.tiled(rows, "block", tile=256)))
    return found.select("ord", F.round("core", 6).alias("core"))


@query("q10_cluster_label", f"""WITH {LABELLED},
w AS (SELECT source, ord, unnest(l) AS value, unnest(range(len(l))) AS pos FROM (SELECT source, ord, list_filter(regexp_extract_all(lower(title), '([a-z][a-z0-9+-]{{2,}})', 1), lambda x: NOT list_contains({sql_list(STOP_WORDS)}, x)) AS l FROM lb)),
r AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY n DESC, o, p) AS k FROM (SELECT source, value, count(*) AS n, min(ord) AS o, arg_min(pos, ord * 1000 + pos) AS p FROM w GROUP BY source, value)),
i AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY n DESC, o, p) AS k FROM (SELECT source, value, count(*) AS n, min(ord) AS o, arg_min(pos, ord * 1000 + pos) AS p
  FROM (SELECT source, ord, unnest(intent_labels) AS value, unnest(range(len(intent_labels))) AS pos FROM lb) GROUP BY source, value))
SELECT s.source, (SELECT string_agg(value, ' ' ORDER BY k) FROM r WHERE r.source = s.source AND k <= 3) || ' [' || (SELECT value FROM i WHERE i.source = s.source AND k = 1) || ']' AS label FROM (SELECT DISTINCT source FROM lb) s""")
def cluster_label(spark, sf):
    return cluster.labels(v.Stored(spark, sf, "labels").evidence, "source")


SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '([.!?])[\\s\\x0b]+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')), lambda s: length(s) >= 12)[1:12]"


@query("q11_segments", f"""WITH s AS (SELECT conv_id, turn, {SENTENCES.format(x="coalesce(text, '')")} AS l FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, CAST(unnest(range(len(l))) AS INT) AS ordinal, unnest(l) AS segment FROM s""")
def segments(spark, sf):
    rows = v.table(spark, sf, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"), "text")
    return ideas.segments(rows, F.col("text"))


@query("q12_heuristic_claims", f"""WITH {LABELLED},
b AS (SELECT id, intent_labels, CASE WHEN suffix(title, '?') THEN title WHEN snippet <> '' THEN snippet ELSE title END AS x FROM lb WHERE list_has_any(intent_labels, ['problem_aware', 'feature_request', 'workaround'])),
f AS (SELECT id, intent_labels, trim(regexp_replace(CASE WHEN trim(regexp_extract(x, '^[^.?!]*')) = '' THEN x ELSE regexp_extract(x, '^[^.?!]*') END, '[\\s\\x0b]+', ' ', 'g')) AS s FROM b)
SELECT id AS evidence_id, CASE WHEN list_contains(intent_labels, 'workaround') THEN 'workaround' ELSE 'pain' END AS claim_type,
  CASE WHEN length(s) <= 100 THEN s ELSE regexp_replace(CASE WHEN contains(s[1:99], ' ') THEN regexp_replace(s[1:99], ' [^ ]*$', '') ELSE s[1:99] END, '[ \t,;:—-]+$', '') || '…' END AS obstacle FROM f""")
def heuristic_claims(spark, sf):
    return ideas.heuristic_claims(v.Stored(spark, sf, "claims").evidence).select("evidence_id", "claim_type", "obstacle")


@query("q13_price_parse", f"""WITH {CLAIMS}, p AS (SELECT ord, CAST(regexp_extract(price_signal, '\\$(\\d+)', 1) AS DOUBLE) AS v, price_signal FROM claims)
SELECT ord, CASE WHEN price_signal LIKE '%year' THEN round(v / 12, 2) ELSE v END AS amount_monthly, regexp_extract(price_signal, '\\$\\d+') AS raw FROM p
WHERE price_signal NOT LIKE '%one-time' AND CASE WHEN price_signal LIKE '%year' THEN round(v / 12, 2) ELSE v END <= 2500""")
def price_parse(spark, sf):
    return v.claims(spark, sf).select("ord", F.explode(parse_prices("price_signal")).alias("p")).select("ord", "p.amount_monthly", "p.raw")


BAND = f"""{CLAIMS}, p AS (SELECT vertical, price_signal, CAST(regexp_extract(price_signal, '\\$(\\d+)', 1) AS DOUBLE) AS x FROM claims WHERE price_signal NOT LIKE '%one-time'),
a AS (SELECT vertical, CASE WHEN price_signal LIKE '%year' THEN round(x / 12, 2) ELSE x END AS m FROM p), band AS (SELECT vertical, count(*) AS n, CAST(0 AS BIGINT) AS free_tier_count,
  quantile_cont(m, 0.25) AS p25, quantile_cont(m, 0.5) AS median_monthly, quantile_cont(m, 0.75) AS p75 FROM a WHERE m <= 2500 AND m > 0 GROUP BY vertical)"""


def band_of(claims):
    return price_band(priced_amounts(claims, ["vertical"], "price_signal"), ["vertical"])


@query("q14_price_band", f"WITH {BAND} SELECT vertical, n, free_tier_count, round(p25, 6) AS p25, round(median_monthly, 6) AS median_monthly, round(p75, 6) AS p75 FROM band")
def band(spark, sf):
    return band_of(v.claims(spark, sf)).select("vertical", "n", "free_tier_count", *[F.round(c, 6).alias(c) for c in ("p25", "median_monthly", "p75")])


@query("q15_price_signal_count", f"WITH {LABELLED} SELECT vertical, count(*) FILTER (WHERE priced) AS priced FROM lb GROUP BY vertical")
def price_signal_count(spark, sf):
    rows = v.evidence(spark, sf).select("vertical", t.folded(F.concat_ws(" ", "title", "snippet")).alias("fold"))
    return rows.groupBy("vertical").agg(F.count_if(t.has_price_signal(F.lit(None), F.col("fold"))).alias("priced"))


SHARE = "round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 4)"
FEATURE_SQL = f"""{LABELLED}, {CLAIMS},
fe AS (SELECT vertical, count(*) AS unique_evidence_count, count(DISTINCT nullif(domain, '')) AS unique_domain_count, count(DISTINCT query_id) AS unique_query_count, count(DISTINCT source) AS unique_source_count,
  {SHARE.format(c=f"list_has_any(intent_labels, {sql_list(HIGH_INTENT)})")} AS high_intent_share, {SHARE.format(c="list_contains(intent_labels, 'workaround')")} AS workaround_share, {SHARE.format(c="list_contains(intent_labels, 'switching')")} AS switching_share,
  bool_or(list_contains(intent_labels, 'comparison')) AS comparison_present, bool_or(list_contains(intent_labels, 'budget_roi')) AS budget_roi_present, count(*) FILTER (WHERE list_contains(intent_labels, 'anti_demand')) AS anti_demand_count,
  count(*) FILTER (WHERE priced) AS rp FROM lb GROUP BY vertical),
fc AS (SELECT vertical, count(price_signal) AS cp, count(DISTINCT brand) AS incumbent_count, max(urgency) AS max_claim_urgency, count(*) AS claim_count FROM claims GROUP BY vertical),
feat AS (SELECT fe.* EXCLUDE (rp), rp + coalesce(cp, 0) AS explicit_price_signal_count, coalesce(incumbent_count, 0) AS incumbent_count, coalesce(max_claim_urgency, 0) AS max_claim_urgency, coalesce(claim_count, 0) AS claim_count FROM fe LEFT JOIN fc USING (vertical))"""


def features_of(held):
    return ideas.features(held.evidence, held.claims, "vertical")


@query("q16_features", f"WITH {FEATURE_SQL} SELECT * FROM feat")
def features(spark, sf):
    return features_of(v.Stored(spark, sf, "features"))


@query("q17_modes", f"""WITH {CLAIMS}, m AS (SELECT vertical, persona AS value, count(*) AS n, row_number() OVER (PARTITION BY vertical ORDER BY count(*) DESC, min(ord), persona) AS place FROM claims WHERE persona <> '' GROUP BY vertical, persona)
SELECT vertical, value, n, CAST(place AS INT) AS place FROM m WHERE place <= 3""")
def modes(spark, sf):
    return cluster.mode_by(v.claims(spark, sf), "vertical", F.col("persona"), F.col("ord"), 3)


def mode_sql(c):
    return f"m_{c} AS (SELECT vertical, {c} FROM (SELECT vertical, {c}, row_number() OVER (PARTITION BY vertical ORDER BY count(*) DESC, min(ord), {c}) AS k FROM claims WHERE {c} <> '' GROUP BY vertical, {c}) WHERE k = 1)"


HYP_SQL = f"""{FEATURE_SQL}, {POLICY}, {', '.join(map(mode_sql, ('persona', 'job', 'obstacle', 'current_workaround')))},
clear AS (SELECT vertical, bool_and(coalesce(enabled AND store_derived, false)) AS ok FROM ev LEFT JOIN pol USING (source) GROUP BY vertical),
pro AS (SELECT lb.*, EXISTS (SELECT 1 FROM claims c WHERE c.evidence_id = lb.id) AS cited FROM lb),
he AS (SELECT vertical, list(id ORDER BY ord) FILTER (WHERE NOT list_contains(intent_labels, 'anti_demand') AND (cited OR list_has_any(intent_labels, ['problem_aware', 'feature_request', 'workaround', 'solution_aware']))) AS evidence_for,
  list(id ORDER BY ord) FILTER (WHERE list_contains(intent_labels, 'anti_demand')) AS evidence_against, bool_or(list_has_any(intent_labels, {sql_list(HIGH_INTENT)})) AS reachable, bool_or(list_contains(intent_labels, 'workaround')) AS wa FROM pro GROUP BY vertical),
hb AS (SELECT vertical, list(DISTINCT brand ORDER BY brand) AS brands FROM claims GROUP BY vertical),
hyp AS (SELECT vertical, persona AS buyer, job, obstacle AS pain, current_workaround, brands[1] AS current_paid_alternative,
  CASE WHEN len(brands) > 0 THEN 'recurring complaints/switching language around: ' || array_to_string(brands, ', ') END AS incumbent_failures, coalesce(evidence_for, []) AS evidence_for, coalesce(evidence_against, []) AS evidence_against,
  CASE WHEN reachable THEN 'search' END AS channel, CASE WHEN wa OR brands IS NOT NULL THEN 'productized_service' ELSE 'software' END AS suggested_form,
  CASE WHEN wa OR brands IS NOT NULL THEN 'fixed_scope_pilot' ELSE 'hybrid_base_plus_usage' END AS pricing_mechanism, CASE WHEN coalesce(ok, true) THEN 'policy_ok_local_research' ELSE 'rights_review_required' END AS compliance_status
  FROM he LEFT JOIN m_persona USING (vertical) LEFT JOIN m_job USING (vertical) LEFT JOIN m_obstacle USING (vertical) LEFT JOIN m_current_workaround USING (vertical) LEFT JOIN hb USING (vertical) LEFT JOIN clear USING (vertical))"""


def hypotheses_of(held):
    return ideas.hypotheses(held.evidence, held.claims, "vertical", policy.rights_clear(held.evidence, v.policies(held.spark), "vertical"))


@query("q18_hypothesis", f"WITH {HYP_SQL} SELECT * REPLACE (len(evidence_for) AS evidence_for, len(evidence_against) AS evidence_against) FROM hyp")
def hypothesis(spark, sf):
    return hypotheses_of(v.Stored(spark, sf, "hypothesis"))


@query("q59_evidence_links", f"""WITH {HYP_SQL}, links AS (SELECT vertical, 'for' AS side, unnest(evidence_for) AS evidence_id FROM hyp UNION ALL SELECT vertical, 'against', unnest(evidence_against) FROM hyp)
SELECT links.vertical, side, ord AS place, evidence_id FROM links JOIN ev ON ev.id = links.evidence_id""")
def evidence_links(spark, sf):
    held = v.Stored(spark, sf, "evidence_links")
    return ideas.evidence_links(held.evidence, held.claims, "vertical")


FORMS_SQL = "forms(form_ord, form, pitch, idea_pricing, smallest_paid_test, mvp_sketch) AS (VALUES " + ", ".join("(" + ", ".join([str(i), *map(quoted, f)]) + ")" for i, f in enumerate(FORMS)) + ")"
IDEA_SQL = f"""{HYP_SQL}, {FORMS_SQL}, idea AS (SELECT hyp.*, form_ord, form, replace(replace(pitch, '{{outcome}}', 'handles: ' || coalesce(nullif(job, ''), 'the recurring job') || ' — ' || coalesce(nullif(pain, ''), 'removes the manual work')),
  '{{incumbent}}', coalesce(nullif(current_paid_alternative, ''), 'A->B')) AS pitch, idea_pricing, smallest_paid_test, mvp_sketch FROM hyp, forms)"""


@query("q19_forms", f"WITH {IDEA_SQL} SELECT vertical, form, pitch, idea_pricing, smallest_paid_test, mvp_sketch FROM idea")
def forms(spark, sf):
    return ideas.forms(hypotheses_of(v.Stored(spark, sf, "forms")), spark).select("vertical", "form", "pitch", "idea_pricing", "smallest_paid_test", "mvp_sketch")


DIMS = {
    "pain_severity": "6 * max_claim_urgency + 4 * workaround_share", "commercial_intent": "10 * high_intent_share", "demand_breadth": "0.5 * unique_evidence_count + unique_domain_count",
    "wtp_proxy": "3 + 2 * least(explicit_price_signal_count, 3) + CASE WHEN incumbent_count > 0 THEN 2 ELSE 0 END",
    "competitive_gap": "CASE WHEN incumbent_count = 0 THEN 4 ELSE greatest(8 - incumbent_count, 3) END + CASE WHEN switching_share > 0 THEN 2 ELSE 0 END",
    "buyer_reachability": "CASE WHEN buyer <> '' THEN 6 ELSE 2 END + CASE WHEN channel <> '' THEN 2 ELSE 0 END + CASE WHEN comparison_present THEN 1 ELSE 0 END",
    "repeatability": "4 + CASE WHEN workaround_share > 0.25 THEN 4 ELSE 0 END + CASE WHEN budget_roi_present THEN 2 ELSE 0 END",
    "compliance_rights": "CASE WHEN compliance_status = 'policy_ok_local_research' THEN 10 ELSE 0 END", "mvp_speed": f"CASE WHEN list_contains({sql_list(FAST_FORMS)}, form) THEN 8 ELSE 5 END",
    "unit_economics": "5 + CASE WHEN explicit_price_signal_count > 0 THEN 2 ELSE 0 END",
}
SCORE_SQL = f"""{IDEA_SQL}, dim AS (SELECT *, {', '.join(f'CAST(greatest(0, least(10, {e})) AS DOUBLE) AS {d}' for d, e in DIMS.items())} FROM idea JOIN feat USING (vertical)),
tot AS (SELECT *, ({' + '.join(f'{d} * {w}' for d, w in WEIGHTS.items())}) / 10 AS total, list_filter([CASE WHEN coalesce(buyer, '') = '' THEN 'buyer_identified' END, CASE WHEN coalesce(channel, '') = '' THEN 'channel_identified' END,
  CASE WHEN smallest_paid_test = '' THEN 'payment_test_defined' END, CASE WHEN compliance_status <> 'policy_ok_local_research' THEN 'rights_clear' END], lambda x: x IS NOT NULL) AS failed FROM dim),
bnd AS (SELECT *, CASE {' '.join(f"WHEN total >= {f} THEN '{b}'" for b, f in BANDS)} ELSE 'archive' END AS reached FROM tot),
scored AS (SELECT *, CASE WHEN len(failed) > 0 AND reached IN ('paid_validation', 'interview') THEN 'collect_more' WHEN reached = 'paid_validation' THEN 'interview' ELSE reached END AS band, len(failed) = 0 AND reached = 'paid_validation' AS awaiting_review,
  round(total, 1) AS score_total FROM bnd)"""


def scored_of(held):
    """Scored ideas, stored: one row for each of a hypothesis's six forms."""
    return held.scratch.put(ideas.scored(ideas.forms(hypotheses_of(held), held.spark).join(features_of(held), "vertical")))


@query("q20_scores", f"WITH {SCORE_SQL} SELECT vertical, form, {', '.join(f'round({d}, 6) AS {d}' for d in DIMS)}, round(total, 6) AS total, array_to_string(failed, ',') AS failed_gates FROM scored")
def scores(spark, sf):
    return scored_of(v.Stored(spark, sf, "scores")).select("vertical", "form", *[F.round(d, 6).alias(d) for d in ideas.dimensions()], F.round("total", 6).alias("total"), F.array_join("failed_gates", ",").alias("failed_gates"))


@query("q21_bands", f"WITH {SCORE_SQL} SELECT vertical, form, score_total, band, awaiting_review FROM scored")
def bands(spark, sf):
    return scored_of(v.Stored(spark, sf, "bands")).select("vertical", "form", "score_total", "band", "awaiting_review")


@query("q22_top3_ideas", f"""WITH {SCORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY total DESC, form_ord) AS place FROM scored), {BAND.replace(CLAIMS + ', ', '')}
SELECT vertical, CAST(place AS INT) AS place, form, pitch, score_total, band, CAST(floor(median_monthly + 0.5) AS INT) AS price_monthly, round(floor(median_monthly + 0.5) * 0.85 * 6, 2) AS cac_ceiling FROM r LEFT JOIN band USING (vertical) WHERE place <= 3""")
def top3_ideas(spark, sf):
    held = v.Stored(spark, sf, "top_ideas")
    spec = ideas.experiment_spec(ideas.top_ideas(scored_of(held), "vertical").join(band_of(held.claims), "vertical", "left"))
    return spec.select("vertical", "place", "form", "pitch", "score_total", "band", F.col("economics_guardrail.price_monthly").cast("int").alias("price_monthly"), F.col("economics_guardrail.cac_ceiling").alias("cac_ceiling"))


@query("q23_competitor_map", f"""WITH {CLAIMS}, c AS (SELECT lower(trim(brand)) AS name, claim_type, persona, ord, obstacle FROM claims WHERE trim(brand) <> ''),
p AS (SELECT name, string_agg(persona, ',' ORDER BY o, persona) AS personas FROM (SELECT name, persona, min(ord) AS o FROM c GROUP BY name, persona) GROUP BY name),
b AS (SELECT name, string_agg(obstacle, ',' ORDER BY o, obstacle) AS obstacles FROM (SELECT name, obstacle, min(ord) AS o FROM c GROUP BY name, obstacle) GROUP BY name)
SELECT name, count(*) AS mention_count, count(*) FILTER (WHERE claim_type = 'switching') AS switching_count, count(*) FILTER (WHERE claim_type = 'switching') / CAST(count(*) AS DOUBLE) AS switching_share, any_value(personas) AS personas, any_value(obstacles) AS obstacles
FROM c JOIN p USING (name) JOIN b USING (name) GROUP BY name""")
def competitor_map(spark, sf):
    return reports.competitor_map(v.claims(spark, sf)).drop("first_ord").withColumns({c: F.array_join(c, ",") for c in ("personas", "obstacles")})


@query("q24_alternatives", f"""WITH {LABELLED}, {CLAIMS} SELECT vertical, (SELECT count(DISTINCT lower(trim(brand))) FROM claims c WHERE c.vertical = lb.vertical) AS direct,
  (SELECT count(current_workaround) FROM claims c WHERE c.vertical = lb.vertical) AS workarounds, count(*) FILTER (WHERE list_contains(intent_labels, 'anti_demand')) AS do_nothing FROM lb GROUP BY vertical""")
def alternatives(spark, sf):
    held = v.Stored(spark, sf, "alternatives")
    return reports.alternatives(held.claims, held.evidence, "vertical")


@query("q27_review_queue", f"""WITH {SCORE_SQL}, f AS (SELECT vertical, list_sort(list_distinct(flatten(list(failed)))) AS g FROM scored GROUP BY vertical)
SELECT vertical, any_value(array_to_string(g, ',')) AS missing_gates, max(score_total) AS best_score, count(*) AS ideas, bool_or(band = 'interview') AS awaiting FROM scored JOIN f USING (vertical) GROUP BY vertical""")
def review_queue(spark, sf):
    scored = scored_of(v.Stored(spark, sf, "review_queue"))
    return reports.review_queue(scored.select("vertical").distinct(), scored, "vertical").withColumn("missing_gates", F.array_join("missing_gates", ","))


@query("q28_evidence_pack", f"""WITH {LABELLED}, {CLAIMS},
c AS (SELECT vertical, 'claim' AS kind, row_number() OVER (PARTITION BY vertical ORDER BY urgency DESC, ord) AS place, evidence_id AS ref FROM claims), e AS (SELECT vertical, 'evidence' AS kind, row_number() OVER (PARTITION BY vertical ORDER BY ord) AS place, id AS ref FROM lb)
SELECT vertical, kind, CAST(place AS INT) AS place, ref FROM c WHERE place <= 10 UNION ALL SELECT vertical, kind, CAST(place AS INT), ref FROM e WHERE place <= 8""")
def evidence_pack(spark, sf):
    return reports.evidence_pack(v.evidence(spark, sf), v.claims(spark, sf), "vertical")
