"""Files that people read: vertical reports, landing pages, project scaffolds, sprint logs.

Sections are small aggregates; they are computed as DataFrames and rendered on the driver, each cut to a stated length.
"""

from __future__ import annotations

import html
import json
import os

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..streaming.daily import LANDING_EVENTS
from . import reports

MOST_IDEAS, MOST_DETAILED, MOST_COMPETITORS, MOST_QUEUED = 20, 3, 8, 5


def write_once(folder: str, name: str, text: str) -> str:
    """Write `text` to a file that is not there yet: name, else name-2, name-3 and so on; returns the path."""
    os.makedirs(folder, exist_ok=True)
    stem, ext = os.path.splitext(name)
    k = 1
    while True:
        path = os.path.join(folder, name if k == 1 else f"{stem}-{k}{ext}")
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(text)
            return path
        except FileExistsError:
            k += 1


def append_line(path: str, line: str) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(line.rstrip("\n") + "\n")


# ---------------------------------------------------------------- report of a vertical
def report_sections(found: DataFrame, claims: DataFrame, ideas: DataFrame, day: Column, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames of a vertical's report over its evidence (labelled, with is_duplicate_of), claims and scored ideas, by title."""
    originals = found.filter("is_duplicate_of IS NULL")
    share = reports.intent_share(originals).select("intent", "n", t.percent(F.col("share")).alias("share"))
    ranked = ideas.orderBy(F.col("score_total").desc(), "form_ord")
    sections = {} if runs is None else {"Collection": reports.collection_summary(runs)}
    sections |= {
        "Evidence": reports.totals(found, "vertical"),
        "Intents": share,
        "Velocity": reports.velocity(found, "vertical", day),
        "Competitors": reports.competitor_map(claims).limit(MOST_COMPETITORS).select("name", "mention_count", "switching_count", t.percent(F.col("switching_share")).alias("switching")),
        "Alternatives": reports.alternatives(claims, found, "vertical"),
        "Ideas": ranked.limit(MOST_IDEAS).select("form", "score_total", "band", F.array_join("failed_gates", ", ").alias("failed_gates")),
        "Best ideas": ranked.limit(MOST_DETAILED).select("form", "pitch", "smallest_paid_test", "mvp_sketch"),
        "Review queue": reports.review_queue(ideas.select("hyp").distinct(), ideas, "hyp").limit(MOST_QUEUED).withColumn("missing_gates", F.array_join("missing_gates", ", ")),
    }
    return sections


def report(vertical: str, sections: dict[str, DataFrame], mode: str) -> str:
    return reports.markdown(f"Evidence report: {vertical}", sections) + f"\nVectors: {mode}\n"


def pack_text(name: str, pack: DataFrame) -> str:
    """A reviewer's pack (kind, place, ref, text) of one hypothesis, a section a kind."""
    kinds = ("claim", "evidence", "idea", "feature", "awaiting")
    return reports.markdown(name, {k: pack.filter(F.col("kind") == k).orderBy("place").select("place", "ref", "text") for k in kinds})


# ---------------------------------------------------------------- landing pages
def landing_content(hypotheses: DataFrame, experiments: DataFrame) -> DataFrame:
    """(idea_id, variant, headline, lead, price, call): two variants of what a page says.

    It follows from the hypothesis (idea_id, buyer, job, pain, pitch) as it is now; a price is shown only if the stored
    experiment (idea_id, price_monthly, price_provenance) says where it comes from.
    """
    text = lambda c, default: F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.lit(default))
    known = F.col("price_monthly").isNotNull() & F.coalesce(F.length("price_provenance") > 0, F.lit(False))
    met = hypotheses.join(experiments.select("idea_id", "price_monthly", "price_provenance"), "idea_id", "left")
    who, job, pain = text(t.title_case(F.col("buyer")), "Your Team"), text("job", "the recurring job"), text("pain", "the manual work")
    price = F.when(known, F.format_string("$%.0f per month", "price_monthly"))
    a = F.struct(F.lit("a").alias("variant"), F.concat(who, F.lit(": "), job).alias("headline"), F.concat(F.lit("No more "), pain).alias("lead"))
    b = F.struct(F.lit("b").alias("variant"), F.concat(F.lit("Done with "), pain, F.lit("?")).alias("headline"), text("pitch", "It is taken care of.").alias("lead"))
    each = met.withColumn("price", price).select("idea_id", "price", F.explode(F.array(a, b)).alias("v"))
    call = F.when(F.col("price").isNotNull(), "Reserve a place").otherwise("Tell me more")
    return each.select("idea_id", "v.variant", "v.headline", "v.lead", "price", call.alias("call"))


def landing_html(content: DataFrame) -> DataFrame:
    """(idea_id, variant, html): static pages, every text escaped."""
    e = t.html_escape
    price = F.when(F.col("price").isNotNull(), F.concat(F.lit('<p class="price">'), e(F.col("price")), F.lit("</p>"))).otherwise("")
    page = F.concat(
        F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), e(F.col("headline")), F.lit("</title></head><body><main><h1>"), e(F.col("headline")),
        F.lit('</h1><p class="lead">'), e(F.col("lead")), F.lit("</p>"), price, F.lit('<a class="cta" href="#reserve" data-variant="'), e(F.col("variant")), F.lit('">'),
        e(F.col("call")), F.lit("</a></main></body></html>\n"),
    )
    return content.select("idea_id", "variant", page.alias("html"))


def write_landing(folder: str, content: DataFrame, idea_id: str) -> list[str]:
    """The pages of one idea, and events.json with what they report."""
    rows = landing_html(content.filter(F.col("idea_id") == idea_id)).collect()
    paths = [write_once(folder, f"{r['variant']}.html", r["html"]) for r in sorted(rows, key=lambda r: r["variant"])]
    events = [{"name": n, "payload": {"variant": "a|b"}} for n in LANDING_EVENTS]
    return [*paths, write_once(folder, "events.json", json.dumps(events, indent=1) + "\n")]


# ---------------------------------------------------------------- project scaffold
def evidence_table(rows: DataFrame, most: int = 20) -> DataFrame:
    """id, title (80 characters, bars replaced), domain of the first rows."""
    return rows.orderBy("ord").limit(most).select("id", F.replace(t.cut(F.col("title"), 80), F.lit("|"), F.lit("/")).alias("title"), "domain")


def scaffold_sections(idea: dict, evidence: list[dict]) -> dict[str, str]:
    """The texts of a project folder, by file name, for an idea with its hypothesis and draft economics."""
    get = lambda k, default="to be found": idea.get(k) or default
    guard = idea.get("economics_guardrail") or {}
    price, cap = guard.get("price_monthly"), guard.get("cac_ceiling")
    table = "| id | title | domain |\n|---|---|---|\n" + "".join(f"| {r['id']} | {r['title']} | {r['domain']} |\n" for r in evidence)
    money = f"${price:g} a month ({guard.get('price_provenance')})" if price else "no price yet: none follows from the evidence"
    return {
        "README.md": f"# {get('pitch')}\n\nFor {get('buyer')}. Form: {get('form')}.\n",
        "evidence.md": f"# Evidence\n\n{table}",
        "prd.md": f"# Requirements\n\nJob: {get('job')}\n\nPain: {get('pain')}\n\nFirst version: {get('mvp_sketch')}\n",
        "pricing.md": f"# Pricing\n\n{money}\n\nMechanism: {get('idea_pricing')}\n",
        "acquisition.md": f"# Acquisition\n\nChannel: {get('channel')}\n\nSpend at most: {f'${cap:g}' if cap else 'nothing before a price is set'}\n",
        "competitors.md": f"# Competitors\n\n{get('current_paid_alternative')}\n\n{get('incumbent_failures', 'no complaints recorded')}\n",
        "experiment.md": f"# Experiment\n\nSmallest paid test: {get('smallest_paid_test')}\n",
        "risks.md": f"# Risks\n\nOpen gates: {', '.join(idea.get('failed_gates') or []) or 'none'}\n\nRights: {get('compliance_status')}\n",
        "decisions.md": "# Decisions\n",
        "project.yaml": yaml.safe_dump({"form": idea.get("form"), "band": idea.get("band"), "score": idea.get("score_total")}, sort_keys=True),
    }


def scaffold(folder: str, idea: dict, evidence: DataFrame) -> list[str]:
    rows = [r.asDict() for r in evidence_table(evidence).collect()]
    return [write_once(folder, name, text) for name, text in scaffold_sections(idea, rows).items()]


def escaped(text: str | None) -> str:
    return html.escape(text or "", quote=True)
