"""Command line over a table store: `python -m oremill.cli --root DIR COMMAND ...`.

Every command is a thin layer over the operators; what it prints is a table or a line of JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as cfg
from .functions.vocabulary import FEATURES
from .operators import artifacts, experiments, lineage, policy, reports, review
from .plans import run
from .sources import payload_source, payloads, store, views
from .sources.scratch import Scratch


class Context:
    """The store, settings, policies and verticals that commands share."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.store = spark, args, store.Store(spark, args.root)
        self.settings = cfg.Settings.load(args.settings)
        self.policies = cfg.load_policies(spark, args.policies) if args.policies else views.policies(spark)
        self.verticals = cfg.load_verticals(args.verticals) if args.verticals else {}
        self.rubric = cfg.load_rubric(args.rubric) if args.rubric else cfg.Rubric()
        # one time for all of a command's jobs
        self.now = F.lit(args.now or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

    def slugs(self) -> list[str]:
        return [v.slug for v in cfg.chosen(self.verticals, self.args.vertical, self.args.all)]

    def specs(self) -> DataFrame:
        """Experiments with the economics of their specification as columns."""
        guard = "economics_guardrail struct<price_monthly:double,price_provenance:string,gross_margin:double,cac_payback_months:int,cac_ceiling:double>, maximum_spend double"
        e = self.store.scan("experiment").withColumn("s", F.from_json("spec", guard))
        g = F.col("s.economics_guardrail")
        return e.withColumns({
            "price": g["price_monthly"], "provenance": g["price_provenance"], "margin": g["gross_margin"], "months": g["cac_payback_months"], "cap": g["cac_ceiling"], "spend": F.col("s.maximum_spend"),
        }).drop("s")


def show(rows: DataFrame, most: int = 50) -> None:
    print("\t".join(rows.columns))
    for r in rows.limit(most).collect():
        print("\t".join("" if x is None else str(x) for x in r))


def doctor(c: Context) -> None:
    tables = c.store.init()
    problems = [r.asDict() for r in policy.lint(c.policies).collect()]
    print(json.dumps({"tables": tables, "schema_version": store.SCHEMA_VERSION, "policy_problems": problems, "spark": c.spark.version}))


def policies(c: Context) -> None:
    show(policy.lint(c.policies) if c.args.lint else policy.sources(c.policies))


def collect(c: Context) -> None:
    """Replay payload files: gate them, log the runs, store the rows of each vertical's queries.

    --payloads names a folder of folders `source=NAME`, of which only those that may be collected are read, or files that
    name their source in each line.
    """
    chosen = [cfg.find_vertical(c.verticals, s) for s in c.slugs()]
    new = cfg.seed_queries(c.spark, chosen).withColumn("id", payloads.natural_id("q", F.col("vertical"), F.col("text"))).withColumn("created_at", c.now)
    with Scratch(c.spark, "collect") as scratch:
        c.store.replace("query", scratch.put(payloads.upsert(c.store.scan("query"), c.store.shaped("query", new), ["text", "vertical"])))
        queries = c.store.scan("query", F.col("vertical").isin(*[v.slug for v in chosen])).select(F.col("text").alias("query"), F.col("id").alias("query_id"), "vertical")
        names = payload_source.folders(c.spark, c.args.payloads)
        if names:
            raw = payload_source.read_gated(c.spark, c.args.payloads, c.policies)
            wanted = [(v.slug, s) for v in chosen for s in v.sources or c.settings.sources or names]
            requests = queries.join(F.broadcast(c.spark.createDataFrame(wanted, "vertical string, source string")), "vertical")  # a few names a vertical
        else:
            raw = payloads.read_payloads(c.spark, c.args.payloads)
            sources = raw.select("query", "source").distinct()
            requests, names = sources.join(queries, "query"), [r["source"] for r in raw.select("source").distinct().collect() if r["source"]]
        if c.args.source:
            requests = requests.filter(F.col("source") == c.args.source)
        runs, found = payloads.collected(raw, requests, names, c.policies, c.args.limit or c.settings.results_per_query, c.now)
        runs, found = scratch.put(runs), scratch.put(found)
        held = c.store.scan("source_run").select("id")
        c.store.append("source_run", runs.withColumnRenamed("source_run_id", "id").withColumn("started_at", c.now).withColumn("finished_at", c.now).join(held, "id", "left_anti"))
        c.store.append("evidence_event", found.join(c.store.scan("evidence_event").select("id"), "id", "left_anti"))
    show(reports.collection_summary(c.store.scan("source_run")))


def pipeline(c: Context) -> None:
    batch = run.run_all(c.slugs(), lambda slug: run.run(c.store, [slug], c.policies, c.now, c.settings, c.rubric))
    print(json.dumps({"results": batch.results, "failed": batch.failed}))


def report(c: Context) -> None:
    for slug in c.slugs():
        found = views.labelled(c.store.scan("evidence_event", vertical=slug)).withColumn("ord", F.unix_micros("fetched_at"))
        scored = c.store.scan("product_idea", vertical=slug).withColumn("form_ord", F.col("form")).withColumn("hyp", F.col("hypothesis_id"))
        claims = store.claims_of(c.store, slug).withColumn("ord", F.unix_micros("created_at"))
        sections = artifacts.report_sections(found, claims, scored, F.to_date("fetched_at"), store.runs_of(c.store, slug))
        print(artifacts.write_once(c.settings.reports_dir, f"{slug}.md", artifacts.report(slug, sections, store.embedding_mode(found))))


def reviews(c: Context) -> None:
    if c.args.set:
        fields = dict(x.split("=", 1) for x in c.args.set)
        edits = c.spark.createDataFrame([(c.args.id, *fields.values())], ", ".join(f"{n} string" for n in ("id", *fields)))
        show(review.apply_review(c.store, edits, c.now, c.rubric.weights, c.rubric.bands))
    elif c.args.id:
        print(json.dumps(c.store.require("problem_hypothesis", c.args.id), default=str))
    else:
        hyps = c.store.scan("problem_hypothesis").select(F.col("id").alias("hypothesis_id"))
        show(review.queue(hyps, c.store.scan("product_idea"), "hypothesis_id"))


def outcomes(c: Context) -> None:
    if c.args.action == "list":
        show(c.store.scan("outcome").orderBy("observed_at", "id"))
    elif c.args.action == "export":
        payloads.export_outcomes(c.store.scan("outcome"), c.args.path)
    else:
        if c.args.action == "import":
            rows = payloads.import_outcomes(c.spark, c.args.path)
        else:
            rows = c.spark.createDataFrame([(c.args.id, c.args.kind, c.args.value or "")], "experiment_id string, kind string, value string")
        checked = Scratch(c.spark, "import").put(experiments.import_refusals(rows, c.store.scan("experiment")))
        good = experiments.accepted(checked, c.args.keep_going).withColumn("observed_at", c.now)
        c.store.append("outcome", good.withColumn("id", payloads.natural_id("out", F.col("experiment_id"), F.col("kind"), F.coalesce("value", F.lit("")), c.now.cast("string"))))
        show(checked.groupBy(F.coalesce("refusal", F.lit("accepted")).alias("result")).count())


def experiment(c: Context) -> None:
    held = c.specs()
    if c.args.action == "list":
        show(held.select("id", "idea_id", "status", "price", "decision").orderBy("id"))
        return
    if c.args.action == "decide":
        asked = c.spark.createDataFrame([(c.args.id, c.args.decision, c.args.reason)], "experiment_id string, decision string, reason string")
        done = Scratch(c.spark, "decide").put(experiments.decide(held, c.store.scan("outcome"), asked))
        show(done)
        ok = done.filter("refusal IS NULL").select(F.col("experiment_id").alias("id"), F.col("new_status").alias("status"), "decision", "decision_reason")
        added = done.filter("outcome_kind IS NOT NULL").select(payloads.natural_id("out", F.col("experiment_id"), F.col("outcome_kind"), c.now.cast("string")).alias("id"), "experiment_id", F.col("outcome_kind").alias("kind"), F.lit("{}").alias("value"), c.now.alias("observed_at"))
        c.store.append("outcome", added)
        c.store.replace("experiment", Scratch(c.spark, "decided").put(payloads.updated(c.store.scan("experiment"), ok, "id")))
        return
    ids = c.spark.createDataFrame([(c.args.id, c.args.price)], "id string, price double")
    done = experiments.started(held, ids, F.to_date(c.now)) if c.args.action == "start" else experiments.stopped(held, ids)
    done = Scratch(c.spark, "lifecycle").put(done)
    show(done.filter(F.col("id") == c.args.id).select("id", "status", "price", "provenance", "refusal"))
    guard = F.struct(F.col("price").alias("price_monthly"), F.col("provenance").alias("price_provenance"), F.col("margin").alias("gross_margin"), F.col("months").alias("cac_payback_months"), F.col("cap").alias("cac_ceiling"))
    c.store.replace("experiment", done.withColumn("spec", F.to_json(F.struct(guard.alias("economics_guardrail"), F.col("spend").alias("maximum_spend")))))


def calibration(c: Context) -> None:
    snaps, held = c.store.scan("score_snapshot"), c.store.scan("experiment")
    if c.args.show:
        model = cfg.load_model(c.args.model)
        for name, w in sorted((model or {"weights": {}})["weights"].items(), key=lambda x: -abs(x[1])):
            print(f"{name}\t{w:.4f}")
        return
    rows = experiments.calibration_dataset(snaps, held, c.store.scan("outcome"))
    show(experiments.decision_counts(rows))
    if c.args.fit:
        flat = rows.withColumns({f: F.coalesce(F.col("features")[f], F.lit(0.0)) for f in FEATURES})
        model = experiments.fit_logistic(experiments.encoded(flat), FEATURES, experiments.parse_l2(c.args.l2))
        print(cfg.save_model(model, c.args.model, c.args.now or "latest"))
    if c.args.sprint_log:
        n = held.groupBy("status").count().collect()
        artifacts.append_line(c.args.sprint_log, json.dumps({r["status"]: r["count"] for r in n}, sort_keys=True))


def idea_list(c: Context) -> None:
    show(store.ideas_by(c.store, c.args.vertical, c.args.band).select("id", "vertical", "form", "score_total", "band"))


def _idea(c: Context) -> dict:
    idea = c.store.require("product_idea", c.args.id)
    return c.store.require("problem_hypothesis", idea["hypothesis_id"]) | idea | {"idea_pricing": idea["pricing_mechanism"]}


def bootstrap(c: Context) -> None:
    idea = _idea(c)
    draft = reports.latest(c.store.scan("experiment", idea_id=c.args.id), "idea_id", "created_at", "id").collect()
    if draft:
        idea |= json.loads(draft[0]["spec"])
    cited = c.store.scan("hypothesis_evidence", hypothesis_id=idea["hypothesis_id"]).select(F.col("evidence_id").alias("id"), F.col("place").alias("ord"))
    print("\n".join(artifacts.scaffold(f"{c.settings.ideas_dir}/{c.args.id}", idea, cited.join(c.store.scan("evidence_event"), "id"))))


def landing(c: Context) -> None:
    """Pages of an idea; refused if they show collected text or their evidence is gone."""
    idea = _idea(c)
    hyp = c.spark.createDataFrame([tuple(idea.get(k) for k in ("id", "buyer", "job", "pain", "pitch"))], "idea_id string, buyer string, job string, pain string, pitch string")
    drafts = c.specs().select("idea_id", F.col("price").alias("price_monthly"), F.col("provenance").alias("price_provenance"))
    content = artifacts.landing_content(hyp, drafts)
    shown = content.select(F.col("variant").alias("artifact"), F.concat_ws(" ", "headline", "lead").alias("text"))
    cited = c.store.scan("hypothesis_evidence", hypothesis_id=idea["hypothesis_id"]).select(F.col("evidence_id").alias("id"))
    lineage.assert_not_redisplayed(shown, c.store.scan("evidence_event").join(cited, "id", "left_semi"), ["title", "snippet"], cited)
    print("\n".join(artifacts.write_landing(f"{c.settings.ideas_dir}/{c.args.id}/landing", content, c.args.id)))


def deletions(c: Context) -> None:
    """Rows past their source's retention, or withdrawn by it (--notices), and all that hangs on them, leave the store."""
    held = c.store.scan("evidence_event")
    with Scratch(c.spark, "purge") as scratch:
        if c.args.notices:
            notices = c.spark.read.schema("source string, canonical_url string").option("header", True).csv(c.args.notices)
            gone, reason = lineage.withdrawn(held, notices), "upstream"
        else:
            gone, reason = lineage.expired(held, c.policies, c.now), "retention"
        show(purge(c.store, scratch.put(gone.select("id", "source")), reason, c.now, scratch))


def purge(held: store.Store, gone: DataFrame, reason: str, now, scratch: Scratch) -> DataFrame:
    """Delete rows (id, source) along their lineage: children go, links of duplicates are mended, an audit row a source is kept."""
    names = {"claims": "pain_claim", "segments": "text_segment", "memberships": "cluster_member"}
    counts, left = lineage.delete(gone, {k: held.scan(t) for k, t in names.items()} | {"payloads": held.scan("raw_payload")})
    audit = lineage.audit(gone, counts, reason).withColumn("created_at", now)
    named = scratch.put(audit.withColumn("id", payloads.natural_id("del", F.col("source"), F.lit(reason), now.cast("string"))))
    sizes = left["memberships"].groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n"))
    clusters = scratch.put(held.scan("cluster").join(sizes, "id", "left").withColumn("member_count", F.coalesce("n", F.lit(0))))
    rows = held.scan("evidence_event")
    links = rows.select("id", F.unix_micros("fetched_at").alias("ord"), "is_duplicate_of", "dedupe_stage")
    mended = lineage.relinked(links, gone, scratch.put).drop("ord")
    kept = scratch.put(rows.drop("is_duplicate_of", "dedupe_stage").join(mended, "id"))
    for k, t in (names | {"payloads": "raw_payload"}).items():
        held.replace(t, left[k])
    held.replace("cluster", clusters)
    held.replace("evidence_event", kept)
    held.append("deletion_event", named)
    held.append("deleted_evidence", gone.join(named.select("source", F.col("id").alias("deletion_id")), "source").select("deletion_id", F.col("id").alias("evidence_id")))
    return named


def competitors(c: Context) -> None:
    for slug in c.slugs():
        claims = store.claims_of(c.store, slug).withColumn("ord", F.unix_micros("created_at"))
        show(reports.competitor_map(claims).select("name", "mention_count", "switching_count"))
        show(reports.alternatives(claims, c.store.scan("evidence_event", vertical=slug), "vertical"))


def queries(c: Context) -> None:
    """Seed queries, and those that an answer file of a language model proposes."""
    from .sources import models

    seeds = cfg.seed_queries(c.spark, [cfg.find_vertical(c.verticals, s) for s in c.slugs()]).select("text", "ord")
    held = c.store.scan("query").select("text")
    if c.args.answer:
        answer = c.spark.read.text(c.args.answer, wholetext=True).withColumnRenamed("value", "answer")
        show(payloads.effective_queries(seeds, models.expanded(answer, seeds, held)))
    else:
        show(seeds)


def vertical_list(c: Context) -> None:
    for v in c.verticals.values():
        print(f"{v.slug}\t{v.name}\t{len(v.queries)}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="oremill", description=__doc__.splitlines()[0])
    p.add_argument("--root", required=True, help="folder of the table store")
    for name in ("settings", "policies", "verticals", "rubric"):
        p.add_argument(f"--{name}", help=f"YAML file of {name}")
    p.add_argument("--now", help="the time that counts as now, for runs that can be repeated")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, call, *options, vertical=False):
        s = sub.add_parser(name, help=(call.__doc__ or "").split("\n")[0])
        s.set_defaults(call=call)
        if vertical:
            s.add_argument("--vertical")
            s.add_argument("--all", action="store_true")
        for flags, kw in options:
            s.add_argument(*flags.split(), **kw)

    flag, text = {"action": "store_true"}, {}
    command("doctor", doctor)
    command("policy", policies, ("--lint", flag))
    command("collect", collect, ("--payloads", {"required": True}), ("--limit", {"type": int, "choices": range(1, 31), "metavar": "1-30"}), ("--source", text), vertical=True)
    command("pipeline", pipeline, vertical=True)
    command("report", report, vertical=True)
    command("review", reviews, ("--id", text), ("--set", {"action": "append", "metavar": "FIELD=VALUE"}))
    command("outcomes", outcomes, ("action", {"choices": ["record", "list", "import", "export"]}), ("--path", text), ("--id", text), ("--kind", text), ("--value", text), ("--keep-going", flag))
    command("experiments", experiment, ("action", {"choices": ["list", "start", "stop", "decide"]}), ("--id", text), ("--price", {"type": float}), ("--decision", text), ("--reason", text))
    command("calibration", calibration, ("--fit", flag), ("--show", flag), ("--l2", text), ("--model", {"default": "weights.json"}), ("--sprint-log", text))
    command("ideas", idea_list, ("--vertical", text), ("--band", text))
    command("bootstrap", bootstrap, ("--id", {"required": True}))
    command("landing", landing, ("--id", {"required": True}))
    command("deletions", deletions, ("--notices", text))
    command("competitors", competitors, vertical=True)
    command("queries", queries, ("--answer", text), vertical=True)
    command("verticals", vertical_list)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.call(Context(spark or SparkSession.builder.appName("oremill").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args))


if __name__ == "__main__":
    main(sys.argv[1:])
