"""Views of the evidence model in DuckDB SQL, for the oracles."""

from __future__ import annotations

from ..functions.vocabulary import INTENTS, PRICE_SIGNAL, RIGHT_NAMES, RIGHTS
from ..sources.views import PRICE_SUFFIXES, SOURCES, TITLES, VERTICALS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def norm(x: str) -> str:
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {quoted(code)}, {quoted(plain)})"
    return f"trim(regexp_replace({x}, '[\\s\\x0b ]+', ' ', 'g'))"


def near(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({norm(x)}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def labels(x: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({x}, {quoted('(?i)' + p)}) THEN {quoted(n)} END" for n, p in INTENTS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


EV = f"""ev AS (SELECT doc_id AS ord, 'ev_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, {sql_list(VERTICALS)}[doc_id % 3 + 1] AS vertical, 'q_' || (doc_id % 25) AS query_id,
  {sql_list(SOURCES)}[CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 6 + 1] AS source, 'https://example.com/' || lang || '/' || (doc_id % 3) AS canonical_url, source || '.example.com' AS domain,
  {sql_list(TITLES)}[n_chars % 16 + 1] AS title, coalesce(text, '') AS snippet, lang, CAST(DATE '2024-01-01' + to_days(CAST(doc_id % 40 AS INT)) AS DATE) AS fetched_at FROM documents)"""
HASHED = f"""{EV}, hashed AS (SELECT *, sha256(canonical_url || '|' || {norm('title')} || '|' || {norm('snippet')}) AS content_hash, {near("title || ' ' || snippet")} AS near_dup_key FROM ev)"""
DUPES = f"""{HASHED}, ex AS (SELECT *, first_value(id) OVER (PARTITION BY content_hash ORDER BY ord) AS exact_of FROM hashed),
nr AS (SELECT *, CASE WHEN exact_of = id AND near_dup_key <> '' THEN first_value(id) OVER (PARTITION BY near_dup_key, exact_of = id ORDER BY ord) ELSE id END AS near_of FROM ex),
dd AS (SELECT *, CASE WHEN exact_of <> id THEN exact_of WHEN near_of <> id THEN near_of END AS is_duplicate_of, CASE WHEN exact_of <> id THEN 'exact' WHEN near_of <> id THEN 'near' END AS dedupe_stage FROM nr)"""
LABELLED = f"""{EV}, lb AS (SELECT *, {labels("title || ' ' || snippet")} AS intent_labels, regexp_matches(title || ' ' || snippet, {quoted('(?i)' + PRICE_SIGNAL)}) AS priced FROM ev)"""
CLAIMS = f"""claims AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'ev_' || lpad(CAST(l_suppkey * 10 + l_linenumber AS VARCHAR), 8, '0') AS evidence_id, {sql_list(VERTICALS)}[(l_suppkey * 10 + l_linenumber) % 3 + 1] AS vertical,
  CASE WHEN l_returnflag = 'R' THEN 'switching' ELSE 'pain' END AS claim_type, c_mktsegment AS persona, p_type AS job, p_name AS obstacle, CASE WHEN l_linestatus = 'O' THEN 'spreadsheet' END AS current_workaround,
  '$' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) || {sql_list(PRICE_SUFFIXES)}[l_linenumber % 4 + 1] AS price_signal, least(l_discount * 10, 1.0) AS urgency, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
EXPERIMENTS = "exps AS (SELECT 'exp_' || o_orderkey AS id, o_orderkey AS ord, 'idea_' || o_custkey AS idea_id, CASE o_orderstatus WHEN 'P' THEN 'draft' WHEN 'O' THEN 'running' WHEN 'F' THEN 'stopped' END AS status, o_orderdate AS created_at, o_totalprice AS spend, o_orderpriority AS priority FROM orders)"
IDEAS = f"ideas AS (SELECT 'idea_' || c_custkey AS id, {sql_list(VERTICALS)}[c_custkey % 3 + 1] AS vertical, c_acctbal AS balance FROM customer)"
OUTCOMES = "outs AS (SELECT 'out_' || event_id AS id, event_id AS ord, 'exp_' || event_id AS experiment_id, CASE event_type WHEN 'signup' THEN 'email_signup' WHEN 'purchase' THEN 'payment_received' WHEN 'click' THEN 'demo_request' WHEN 'view' THEN 'price_shown_interest' WHEN 'error' THEN 'kill' END AS kind, props AS value, ts AS observed_at FROM events)"
POLICY = "pol(source, enabled, " + ", ".join(RIGHT_NAMES) + ", authorised, retention_days) AS (VALUES " + ", ".join("(" + ", ".join([quoted(n), *[str(v).lower() for v in r]]) + ")" for n, r in RIGHTS.items()) + ")"
