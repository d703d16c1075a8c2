"""Operators on small golden inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oremill.errors import FitRefused, LabelDiversityError, LeakageError, RedisplayError
from oremill.functions import text
from oremill.functions.vocabulary import FEATURES, WEIGHTS
from oremill.operators import cluster, dedupe, experiments, ideas, lineage, policy, reports
from oremill.sources import payloads, views
from oremill.sources.scratch import Scratch
from oremill.streaming import daily


def test_exact_and_near(spark):
    rows = [("ev1", 1, "h1", "alpha beta"), ("ev2", 2, "h1", "alpha beta"), ("ev3", 3, "h2", "alpha beta"), ("ev4", 4, "h3", "other thing"), ("ev5", 5, "h4", ""), ("ev6", 6, "h5", ""), ("ev7", 7, "h2", "alpha beta")]
    df = spark.createDataFrame(rows, "id string, ord int, content_hash string, near_dup_key string").withColumn("near_key_hash", text.key_hash(F.col("near_dup_key")))
    got = {r.duplicate: (r.stage, r.original) for r in dedupe.pair_list(dedupe.duplicates(df)).collect()}
    assert got == {"ev2": ("exact", "ev1"), "ev3": ("near", "ev1"), "ev7": ("exact", "ev3")}


def test_leaders_agree_and_follow_order(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("ord"), "embedding", F.lit("x").alias("b")).cache()
    for threshold in (0.4, 0.3):
        scan = {r.ord: r.leader for r in dedupe.leader_scan(df, threshold, "b").collect() if r.ord != r.leader}
        for tile in (2048, 100):
            pairs = dedupe.similar_pairs(df, threshold, tile=tile).cache()
            assert {r.duplicate: r.leader for r in dedupe.leaders_by_rounds(pairs).collect()} == scan
    small = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "x"), (2, [0.99, 0.02, 0.0], "x"), (3, None, "x")], "ord long, embedding array<double>, b string")
    assert [tuple(r)[:2] for r in dedupe.leader_scan(small, 0.97, "b").collect()] == [(1, 1), (2, 1)]


def test_greedy_clusters(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.98, 0.05], "x"), (3, [0.0, 1.0], "x"), (4, [], "x"), (5, None, "x")], "ord long, embedding array<double>, b string")
    found = cluster.greedy_clusters(df, 0.9, "b")
    assert sorted(r["count"] for r in found.groupBy("cluster").count().collect()) == [1, 1, 1, 2]
    assert [r.members for r in cluster.groups(found, "b").collect()] == [2]


FEATURE_ROW = dict.fromkeys(FEATURES, 0) | {"comparison_present": False, "budget_roi_present": False}
HYP = {"buyer": "b", "channel": "search", "smallest_paid_test": "t", "compliance_status": "policy_ok_local_research"}


def score(spark, features, form, reviewed=False, weights=None, **hyp):
    row = {k: (v if isinstance(v, bool) else float(v)) for k, v in (FEATURE_ROW | features).items()} | HYP | hyp | {"form": form}
    df = spark.createDataFrame([row], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))
    return ideas.scored(df, weights, F.lit(reviewed)).first()


def test_scores_and_bands(spark):
    assert sum(WEIGHTS.values()) == 100
    high = {"unique_evidence_count": 14, "unique_domain_count": 8, "high_intent_share": 1.0, "workaround_share": 0.5, "switching_share": 0.2, "comparison_present": True, "budget_roi_present": True, "explicit_price_signal_count": 4, "incumbent_count": 1, "max_claim_urgency": 0.9}
    r = score(spark, high, "productized_service")
    assert abs(r.pain_severity - 7.4) < 1e-9 and r.wtp_proxy == 10 and r.competitive_gap == 9 and r.buyer_reachability == 9 and r.repeatability == 10 and r.mvp_speed == 8 and r.unit_economics == 7
    assert (r.band, r.awaiting_review, r.score_total) == ("interview", True, 91.6)
    assert score(spark, high, "productized_service", reviewed=True).band == "paid_validation"
    capped = score(spark, high, "productized_service", buyer=None)
    assert capped.band == "collect_more" and capped.failed_gates == ["buyer_identified"]
    low = {"unique_evidence_count": 2, "unique_domain_count": 1, "high_intent_share": 0.1, "workaround_share": 0.05, "max_claim_urgency": 0.2}
    assert score(spark, low, "software").band == "archive"
    assert score(spark, high, "software", weights={"mvp_speed": 100}).score_total == 50.0


def test_heuristic_claims_and_modes(spark):
    rows = [("a", 1, "How do I export?", "x", ["problem_aware"]), ("b", 2, "t", "snippet text. more", ["workaround"]), ("c", 3, "t", "", ["feature_request"]), ("d", 4, "t", "s", ["switching"])]
    df = spark.createDataFrame(rows, "id string, ord int, title string, snippet string, intent_labels array<string>")
    got = [tuple(r) for r in ideas.heuristic_claims(df).select("evidence_id", "claim_type", "obstacle").collect()]
    assert got == [("a", "pain", "How do I export"), ("b", "workaround", "snippet text"), ("c", "pain", "t")]
    assert ideas.extracted(df.select(F.lit("zz").alias("evidence_id")), df).count() == 3
    m = spark.createDataFrame([("k", "x", 2), ("k", "y", 1), ("k", "x", 4), ("k", "y", 3), ("k", "", 0), ("k", None, 0)], "k string, v string, ord int")
    assert cluster.mode_by(m, "k", F.col("v"), F.col("ord")).first()["value"] == "y"


def test_policy(spark):
    p = views.policies(spark)
    ask = lambda s, u: policy.decisions(spark.createDataFrame([(s, u)], "source string, purpose string"), p).first()
    assert ask("searxng", "COLLECT").allowed and not ask("reddit", "COLLECT").allowed and ask("nobody", "COLLECT").reason == "unknown source" and not ask("searxng", "DREAM").allowed
    with pytest.raises(Exception, match="denied"):
        policy.require(policy.decisions(spark.createDataFrame([("reddit", "TRAINING")], "source string, purpose string"), p)).collect()
    assert policy.lint(p).count() == 0
    assert {r.problem for r in policy.lint(p.limit(0)).collect()} == {"the registry is empty", "no source is enabled"}
    assert [r.source for r in policy.sources(p, True).collect()] == ["searxng"]


def test_payloads(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(
        '{"query":"q1","source":"searxng","results":[{"url":"","title":"x"},{"url":"https://www.a.com/x/?ref=1","title":"A &amp; B","content":" s  t ","engines":["g","b"],"score":0.5},{"url":"https://b.com","title":"late"}]}\n'
        '{"query":"q2","source":"reddit","results":[]}\n{"query":"q3","source":"searxng","results":[]}\n{"query":"q4","source":"searxng","error":"timeout"}\n'
    )
    p, raw = views.policies(spark), payloads.read_payloads(spark, str(path))
    assert {r.query: r.status for r in payloads.batches(raw, p, 2).collect()} == {"q1": "ok", "q2": "disabled", "q3": "empty", "q4": "error"}
    rows = payloads.evidence_rows(payloads.records(raw, 2), p, "alpha", F.current_timestamp()).collect()
    assert [(r.canonical_url, r.domain, r.title, r.snippet, r.engine) for r in rows] == [("https://a.com/x", "a.com", "A & B", "s t", "g, b")] and rows[0].rights_profile.store_derived
    held = spark.createDataFrame([("a", "v")], "text string, vertical string")
    assert payloads.upsert(held, spark.createDataFrame([("a", "v"), ("b", "v"), ("b", "v")], held.schema), ["text", "vertical"]).count() == 2
    assert payloads.updated(held, spark.createDataFrame([("a", "w")], held.schema), "text").first().vertical == "w"
    got = payloads.sanitised(spark.createDataFrame([("New  One", 1), ("new one", 2), (" ", 3), ("x" * 81, 4), ("known", 5), ("z", 6), ("y", 7)], "text string, ord int"), spark.createDataFrame([("KNOWN",)], "text string"), 2)
    assert [r.text for r in got.collect()] == ["New  One", "z"]


def test_lineage(spark):
    ev = spark.createDataFrame([("e1", "searxng"), ("e2", "searxng")], "id string, source string")
    seg = spark.createDataFrame([("e1", "s1"), ("e1", "s2"), ("e2", "s3")], "evidence_id string, s string")
    cl = spark.createDataFrame([("e1", "c1")], "evidence_id string, c string")
    counts, left = lineage.delete(ev.filter("id = 'e1'"), {"segments": seg, "claims": cl})
    assert tuple(counts.first()) == ("e1", 2, 1) and left["segments"].count() == 1 and left["claims"].count() == 0
    assert lineage.audit(ev, counts, "r").first().deleted == 1
    for n, hits in ((6, 0), (7, 1), (9, 1)):
        a = lineage.word_grams(spark.createDataFrame([("a", "New copy: " + " ".join(f"W{i}" for i in range(n)) + " end")], "k string, t string"), "k", F.col("t"))
        b = lineage.word_grams(spark.createDataFrame([("b", "old " + " ".join(f"w{i}" for i in range(n)) + " other")], "j string, t string"), "j", F.col("t"))
        assert [r.longest for r in lineage.shared_runs(a, b, "k", "j").collect()] == [n] * hits
    assert [r.id for r in lineage.missing(spark.createDataFrame([("e1",), ("e9",)], "id string"), ev).collect()] == ["e9"]


def test_grams_are_thinned_before_they_are_dealt(spark, monkeypatch):
    """Only grams that the smaller side may hold meet an exchange; a filter of few keys lets more through and changes no result."""
    text = lambda name, k: " ".join(f"{name}{i}" for i in range(k))
    rows = spark.createDataFrame([(i, text(f"x{i}_", 300) + " " + text("s", 9 + i)) for i in range(4)], "id int, text string")
    shown = spark.createDataFrame([("page", "see " + text("s", 11))], "artifact string, text string")
    want = [(i, "s0 s1 s2 s3 s4 s5 s6") for i in range(4)]
    for keys in (lineage.FILTER_KEYS, 2):
        monkeypatch.setattr(lineage, "FILTER_KEYS", keys)
        got = lineage.redisplayed(shown, rows, ["text"])
        assert sorted((r.evidence_id, r.span) for r in got.collect()) == want
        held, known = lineage.word_grams(rows, "id", F.col("text")), lineage.word_grams(shown, "artifact", F.col("text"))
        assert [(r.id, r.longest) for r in lineage.shared_runs(held, known, "id", "artifact").orderBy("id").collect()] == [(0, 9), (1, 10), (2, 11), (3, 11)]
        for plan in (got, lineage.shared_runs(held, known, "id", "artifact")):
            assert "BroadcastHashJoin [__key" in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    assert lineage.may_share(held, known).count() < 40 < held.count()


def test_experiments(spark):
    e = spark.createDataFrame([("x", "running"), ("y", "draft")], "id string, status string")
    o = spark.createDataFrame([("x", "deposit_paid")], "experiment_id string, kind string")
    d = spark.createDataFrame([("x", "advance", "z" * 600), ("y", "advance", None), ("x", "iterate", None), ("q", "kill", None)], "experiment_id string, decision string, reason string")
    got = {(r.experiment_id, r.decision): r for r in experiments.decide(e, o, d).collect()}
    assert got["x", "advance"].new_status == "stopped" and len(got["x", "advance"].decision_reason) == 500 and not got["x", "advance"].unpaid_warning
    assert got["y", "advance"].refusal == "illegal transition" and got["x", "iterate"].outcome_kind is None and got["q", "kill"].refusal == "unknown experiment"
    checked = experiments.import_refusals(spark.createDataFrame([("x", "email_signup", ""), ("x", "nope", "{}")], "experiment_id string, kind string, value string"), e)
    assert experiments.accepted(checked).count() == 0 and experiments.accepted(checked, True).count() == 1


def test_fit(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] * 2 - x[:, 1] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), 3.0, int(c)) for (a, b), c in zip(x, y)], "a double, b double, c double, label int")
    model = experiments.fit_logistic(df, ("a", "b", "c"))
    assert model["weights"]["a"] > 1 and model["weights"]["b"] < -0.5 and model["weights"]["c"] == 0
    monkeypatch.setattr(experiments, "BLOCK_ROWS", 50)
    spread = experiments.fit_logistic(df, ("a", "b", "c"), rounds=40)
    monkeypatch.setattr(experiments, "BLOCK_ROWS", 1000)
    alone = experiments.fit_logistic(df, ("a", "b", "c"), rounds=40)
    assert spread["rounds"] == alone["rounds"] and all(abs(spread["weights"][f] - alone["weights"][f]) < 1e-9 for f in "abc")
    p = df.select(experiments.predicted(df, model).alias("p"), "label").collect()
    assert sum((r.p > 0.5) == r.label for r in p) > 240
    with pytest.raises(LabelDiversityError):
        experiments.fit_logistic(df.filter("label = 1"), ("a", "b"))


def test_reports_and_stream(spark, tmp_path):
    days = spark.createDataFrame([("v", "2024-01-01")] * 4 + [("v", "2024-01-05")] * 2 + [("w", "2024-01-01")], "k string, d string")
    assert [tuple(r)[2:] for r in reports.velocity(days, "k", F.to_date("d")).collect()] == [(2, 4.0, 0.5)]
    assert "| k | d |" in reports.markdown("T", {"days": days})
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "h"), (2, "2024-01-01 05:00:00", "h"), (3, "2024-01-02 00:00:00", "g")], "id int, ts string, content_hash string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    assert daily.run_available(daily.first_seen(stream, "ts"), Scratch(spark, "t"), "seen", "append").count() == 2


def test_stream_leaders_and_landing(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "x", [1.0, 0.0]), ("b", "2024-01-01 01:00:00", "x", [0.99, 0.02]), ("c", "2024-01-01 02:00:00", "x", [0.0, 1.0]), ("d", "2024-01-01 02:00:00", "y", [1.0, 0.0]), ("e", "2024-01-01 03:00:00", "y", None)]
    df = spark.createDataFrame(rows, "id string, ts string, block string, embedding array<double>").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "v"))
    got = daily.run_available(daily.leaders(stream, "ts", "block", 0.9), Scratch(spark, "t"), "leaders", "append")
    assert {r.id: r.leader for r in got.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    events = spark.createDataFrame([("view", "a", "i", "2024-01-01 00:10:00"), ("view", "a", "i", "2024-01-01 00:20:00"), ("view", "z", "i", "2024-01-01 00:20:00"), ("dance", "a", "i", "2024-01-01 00:20:00")], "name string, variant string, idea_id string, at string")
    events.withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(daily.LANDING_SCHEMA).parquet(str(tmp_path / "e"))
    assert [r.n for r in daily.run_available(daily.landing_counts(stream), Scratch(spark, "t"), "landing").collect()] == [2]
    old = spark.createDataFrame([("1", "searxng", "2001-01-01"), ("2", "searxng", "2999-01-01"), ("3", "nobody", "2001-01-01")], "id string, source string, at string")
    assert sorted(r.id for r in daily.kept_until(old, "at", views.policies(spark)).collect()) == ["2", "3"]


def test_redisplay_fails_closed(spark):
    rows = spark.createDataFrame([("e1", "t", "one two three four five six seven eight")], "id string, title string, snippet string")
    shown = lambda x: spark.createDataFrame([("page", x)], "artifact string, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    lineage.assert_not_redisplayed(shown("ONE two three four five six"), rows, ["title", "snippet"], ids("e1"))
    with pytest.raises(RedisplayError, match="page shows e1.snippet: 'two three four five six seven eight'"):
        lineage.assert_not_redisplayed(shown("so: Two three four five six SEVEN eight"), rows, ["title", "snippet"])
    with pytest.raises(RedisplayError, match="e2"):
        lineage.assert_not_redisplayed(shown("own words"), rows, ["snippet"], ids("e1", "e2"))


def test_calibration_refuses_leaks(spark):
    snaps = spark.createDataFrame([("i",)], "idea_id string")
    exps = spark.createDataFrame([("x", "i", 1, "kill")], "id string, idea_id string, created_at int, decision string")
    outs = lambda value: spark.createDataFrame([("o", "x", "kill", value)], "id string, experiment_id string, kind string, value string")
    assert experiments.calibration_dataset(snaps, exps, outs("{}")).first().outcomes == 1
    with pytest.raises(LeakageError, match="outcome o"):
        experiments.calibration_dataset(snaps, exps, outs('{"from": "ev_0012ab"}'))
    assert experiments.parse_l2(None) == 0.01 and experiments.parse_l2("0") == 0
    with pytest.raises(FitRefused):
        experiments.parse_l2("-1")
