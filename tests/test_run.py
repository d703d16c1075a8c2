"""The composed run over a store, review, settings, artifacts and model hooks, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from oremill import settings as cfg
from oremill.errors import AnswerNotJson, ConfigError
from oremill.operators import artifacts, review
from oremill.plans import run
from oremill.sources import models, payloads, store, views
from oremill.sources.scratch import Scratch

PAGES = [
    ("How do I stop manual imports?", "It takes forever to copy-paste rows by hand. Is there software that does it?"), ("Best tool for exports", "We compared it to a spreadsheet. Pricing is $20 per month."),
    ("How do I stop manual imports?", "It takes forever to copy-paste rows by hand. Is there software that does it?"), ("Just use scripts", "The free tool is good enough, this is solved."),
]


@pytest.fixture
def held(spark, tmp_path):
    """A store with four collected rows of one vertical; the third repeats the first."""
    p = tmp_path / "p.json"
    rows = [{"url": f"https://www.site{i % 3}.test/{0 if i == 2 else i}?ref=x", "title": t, "content": s, "engines": ["e"], "score": 1.0} for i, (t, s) in enumerate(PAGES)]
    rows[2]["url"] = rows[0]["url"]
    p.write_text(json.dumps({"query": "imports", "source": "searxng", "results": rows}) + "\n")
    s = store.Store(spark, str(tmp_path / "tables"))
    assert set(s.init().values()) == {0}
    found = payloads.evidence_rows(payloads.records(payloads.read_payloads(spark, str(p))), views.policies(spark), "ops", F.lit("2024-05-01").cast("timestamp"))
    s.append("evidence_event", found.withColumn("fetched_at", F.col("fetched_at") + F.make_interval(mins="pos")))
    return s


def test_run_twice_writes_the_same_rows(spark, held):
    now = F.lit("2024-06-01").cast("timestamp")
    first = run.run(held, ["ops"], views.policies(spark), now).first()
    assert (first.originals, first.duplicates, first.claims, first.clusters, first.hypotheses, first.ideas, first.extraction_mode) == (3, 1, 2, 0, 1, 3, "heuristic")
    once = {t: sorted(map(str, held.scan(t).collect())) for t in store.TABLES}
    run.run(held, ["ops"], views.policies(spark), now)
    again = {t: sorted(map(str, held.scan(t).collect())) for t in store.TABLES}
    assert {t: once[t] for t in once if t != "score_snapshot"} == {t: again[t] for t in again if t != "score_snapshot"}
    assert len(again["score_snapshot"]) == 2 * len(once["score_snapshot"]) == 6
    dup = held.scan("evidence_event", F.col("is_duplicate_of").isNotNull()).collect()
    assert [r.dedupe_stage for r in dup] == ["exact"] and store.evidence_for_vertical(held, "ops").count() == 3
    hyp = held.scan("problem_hypothesis").first()
    assert (hyp.evidence_for, hyp.evidence_against, hyp.cluster_id) == (2, 1, None)
    assert held.scan("hypothesis_evidence", hypothesis_id=hyp.id).count() == 3
    assert held.get("product_idea", "nobody") is None
    with pytest.raises(KeyError):
        held.require("experiment", "nobody")
    held.vacuum()
    assert all(len(held.versions(t)) == 1 for t in store.TABLES)


def test_review_writes_back(spark, held):
    run.run(held, ["ops"], views.policies(spark), F.lit("2024-06-01").cast("timestamp"))
    hyp = held.scan("problem_hypothesis").first()
    before = held.scan("score_snapshot").count()
    edits = spark.createDataFrame([(hyp.id, "office managers", None, "policy_ok_local_research", "unheard")], "id string, buyer string, job string, compliance_status string, vertical string")
    scores = review.apply_review(held, edits, F.lit("2024-07-01").cast("timestamp")).collect()
    after = held.scan("problem_hypothesis").first()
    assert (after.buyer, after.job, after.vertical) == ("office managers", hyp.job, "ops")
    assert len(scores) == 3 and held.scan("score_snapshot").count() == before + 3
    assert {r.id: r.band for r in held.scan("product_idea").collect()} == {r.id: r.band for r in scores}
    bad = spark.createDataFrame([(hyp.id, "fine")], "id string, compliance_status string")
    with pytest.raises(Exception, match="unknown compliance status"):
        review.edited(held.scan("problem_hypothesis"), bad).collect()


def test_failures_stay_with_their_vertical(spark):
    def one(slug):
        if slug == "bad":
            raise RuntimeError("x" * 500)
        return spark.createDataFrame([(slug, 1)], "vertical string, ideas int")

    batch = run.run_all(["a", "bad", "b"], one)
    assert list(batch.results) == ["a", "b"] and len(batch.failed["bad"]) == 200


def test_clusters_above_the_cap_and_fallback(spark):
    rows = spark.createDataFrame([(f"e{i}", i, "v", "searxng", i % 12) for i in range(36)] + [("z", 99, "w", "searxng", 0)], "id string, ord long, vertical string, source string, c long")
    found = run.memberships(rows.drop("c"), views.policies(spark), cfg.Settings(), rows.filter("vertical = 'v'").select("vertical", "ord", F.col("c").alias("cluster")))
    assert found.filter("vertical = 'v'").select("hyp").distinct().count() == run.TOP_CLUSTERS
    assert [r.hyp for r in found.filter("vertical = 'w'").collect()] == ["w/all"]


def test_settings(spark, tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("search:\n  results_per_query: 5\npipeline:\n  cluster_threshold: 0.5\n  sources: [searxng, reddit]\n")
    s = cfg.Settings.load(str(f), {"OREMILL_EFFORT": "low", "OREMILL_USE_MODEL_CLAIMS": "false"})
    assert (s.results_per_query, s.cluster_threshold, s.sources, s.effort, s.use_model_claims) == (5, 0.5, ("searxng", "reddit"), "low", False)
    for env in ({"OREMILL_EFFORT": "none"}, {"OREMILL_RESULTS_PER_QUERY": "31"}, {"OREMILL_EMBEDDING_DIM": "many"}):
        with pytest.raises(ConfigError):
            cfg.Settings.load(None, env)
    f.write_text("verticals:\n  a: {name: Alpha, queries: [q1, q2]}\n  b: {}\n")
    known = cfg.load_verticals(str(f))
    assert known["a"].queries == ("q1", "q2") and known["b"].name == "b" and len(cfg.chosen(known, None, True)) == 2
    with pytest.raises(KeyError, match="a, b"):
        cfg.find_vertical(known, "c")
    with pytest.raises(ConfigError):
        cfg.chosen(known, "a", True)
    f.write_text("version: 3\nsources:\n  x: {enabled: true, retention_days: 9, rights: {collect_enabled: true}}\n  y: {}\n")
    p = cfg.load_policies(spark, str(f)).collect()
    assert [(r.source, r.enabled, r.collect_enabled, r.store_raw, r.retention_days, r.policy_version) for r in p] == [("x", True, True, False, 9, 3), ("y", False, False, False, None, 3)]
    f.write_text("dimensions:\n  pain_severity: {weight: 100}\n")
    with pytest.raises(ConfigError):
        cfg.load_rubric(str(f))
    path = str(tmp_path / "m" / "weights.json")
    assert cfg.load_model(path) is None
    copy = cfg.save_model({"weights": {"claim_count": 1.0}, "features": ["claim_count"]}, path, "2024-01-01T10:00:00")
    assert cfg.load_model(path) == cfg.load_model(copy) and "20240101T100000" in copy
    (tmp_path / "m" / "weights.json").write_text("[1]")
    assert cfg.load_model(path) is None
    adapters = cfg.Adapters({"x": lambda spark, asked: asked.select("query"), "z": lambda *_: None})
    assert list(adapters.build(views.policies(spark).withColumn("source", F.lit("x")))) == ["x"]


def test_prompts_are_limited_where_rows_lie(spark):
    """Each task numbers its own lines, cut already, and sends no more of a key than prompts hold."""
    rows = spark.range(4000, numPartitions=4).select(F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("ord"), (F.col("id") % 2).cast("string").alias("vertical"), F.lit("t").alias("title"), F.repeat(F.col("id").cast("string"), 900).alias("snippet"))
    prompts = models.claim_prompts(rows, "vertical")
    assert "WindowGroupLimit" in prompts._jdf.queryExecution().executedPlan().toString()
    lines = [json.loads(x)["id"] for r in prompts.orderBy("vertical", "batch").collect() for x in r.prompt.split("\n")[1:]]
    assert lines == [f"e{i}" for k in (0, 1) for i in range(k, 48, 2)]


def test_model_hooks(spark):
    rows = spark.createDataFrame([(f"e{i}", i, "v", f"title {i}", "s" * 700) for i in range(30)], "id string, ord int, vertical string, title string, snippet string")
    prompts = models.claim_prompts(rows, "vertical")
    lines = [json.loads(x) for r in prompts.orderBy("batch").collect() for x in r.prompt.split("\n")[1:]]
    assert prompts.count() == 4 and [x["id"] for x in lines] == [f"e{i}" for i in range(24)] and {len(x["snippet"]) for x in lines} == {600}

    def chat(prompt):
        if "e6" in prompt:
            raise TimeoutError
        return '```json\n[{"evidence_id": "e1", "claim_type": "pain", "obstacle": "slow"}, {"evidence_id": "invented", "obstacle": "x"}]\n```' if "e1" in prompt else "no idea"

    answers = models.answered(prompts, chat)
    got = models.model_claims(answers, rows, "model-1").collect()
    assert {(r.evidence_id, r.claim_type, r.obstacle, r.model_version) for r in got} == {("e1", "pain", "slow", "model-1")}
    with pytest.raises(AnswerNotJson):
        models.require_json(answers)
    vectors = models.embedded(rows.limit(5), F.col("title"), lambda texts: [[float(len(x)), 1.0] for x in texts], 2)
    assert [list(r.embedding) for r in vectors.collect()] == [[7.0, 1.0]] * 5
    with pytest.raises(Exception, match="0 vectors for 2 texts"):
        models.embedded(rows.limit(2), F.col("title"), lambda texts: []).collect()
    assert [models.embedding_state(*x) for x in ((True, True, True), (False, True, True), (False, True, False))] == ["cached", "local", "unavailable"]
    answer = spark.createDataFrame([('Sure: [{"text": "New one"}, {"text": " new  ONE "}, {"text": "seed"}, {"text": null}, {"text": "other"}]',)], "answer string")
    none = spark.createDataFrame([], "text string")
    assert [r.text for r in models.expanded(answer, spark.createDataFrame([("Seed",)], "text string"), none).orderBy("ord").collect()] == ["New one", "other"]


def test_artifacts(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert [p.rsplit("/", 1)[1] for p in (artifacts.write_once(folder, "r.md", "1"), artifacts.write_once(folder, "r.md", "2"), artifacts.write_once(folder, "r.md", "3"))] == ["r.md", "r-2.md", "r-3.md"]
    hyps = spark.createDataFrame([("i", "small teams", None, "<b>", "p")], "idea_id string, buyer string, job string, pain string, pitch string")
    drafts = spark.createDataFrame([("i", 19.0, "")], "idea_id string, price_monthly double, price_provenance string")
    paths = artifacts.write_landing(folder, artifacts.landing_content(hyps, drafts), "i")
    page = open(paths[0]).read()
    assert "Small Teams: the recurring job" in page and "&lt;b&gt;" in page and "$19" not in page
    assert [e["name"] for e in json.load(open(paths[2]))][0] == "view"
    rows = spark.createDataFrame([("e1", 1, "a|b" + "x" * 90, "d.test")], "id string, ord int, title string, domain string")
    files = artifacts.scaffold(str(tmp_path / "p"), {"pitch": "Thing", "failed_gates": ["rights_clear"], "economics_guardrail": {"price_monthly": 19.0, "price_provenance": "derived", "cac_ceiling": 96.9}}, rows)
    assert len(files) == 10 and "| e1 | a/b" in open(files[1]).read() and "$19 a month (derived)" in open(files[3]).read()


def test_report(spark):
    s = views.Stored(spark, "/root/testdata/sf0.001", "report", hashes=True)
    frames = run.analyse(s.evidence.filter("vertical = 'beta'"), s.claims, views.policies(spark), Scratch(spark, "report"))
    sections = artifacts.report_sections(frames["marked"], s.claims.filter("vertical = 'beta'"), frames["ideas"], F.col("fetched_at"))
    text = artifacts.report("beta", sections, "none")
    assert all(f"## {name}" in text for name in sections) and "Vectors: none" in text


def test_claims_are_stored_once(spark, monkeypatch):
    """What a run writes of claims is one row a claim, of a model or heuristic."""
    s, made, put = views.Stored(spark, "/root/testdata/sf0.001", "once", hashes=True), [], Scratch.put
    given = s.claims.filter("vertical <> 'beta'")
    monkeypatch.setattr(Scratch, "put", lambda self, df: made.append(put(self, df)) or made[-1])
    frames = run.analyse(s.evidence, given, views.policies(spark), Scratch(spark, "once"))
    written = sum(df.count() for df in made if {"evidence_id", "price_signal"} <= set(df.columns))
    assert written == frames["claims"].count() > 0 and {r.extraction_mode for r in frames["counters"].collect()} == {"llm", "heuristic"}


def test_outcome_files_with_odd_rows(spark, tmp_path):
    from oremill.operators import experiments

    (tmp_path / "o.csv").write_text('experiment_id,kind,value\nx,email_signup,{}\nx,email_signup\nx,email_signup,{},more\nx,email_signup,"{""a"": 1}"\n')
    known = spark.createDataFrame([("x", "running")], "id string, status string")
    rows = payloads.import_outcomes(spark, str(tmp_path / "o.csv"))
    assert sorted(str(r.refusal) for r in experiments.import_refusals(rows, known).collect()) == ["None", "None", "wrong number of columns", "wrong number of columns"]
