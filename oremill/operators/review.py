"""Review of hypotheses: queue, pack, edits of the fields that people may change, and the scores that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vocabulary import BANDS, FEATURES
from . import ideas, reports

#: fixed values: what a reviewer may set, the compliance states, and the lengths of a pack
REVIEWABLE = (
    "title", "buyer", "job", "pain", "current_workaround", "current_paid_alternative", "incumbent_failures", "channel", "smallest_paid_test", "fastest_mvp", "compliance_status",
)
COMPLIANCE = ("unreviewed", "policy_ok_local_research", "rights_review_required")
PACK_CLAIMS, PACK_EVIDENCE, PACK_CHARS = 10, 8, 140


def queue(hypotheses: DataFrame, product_ideas: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Hypotheses with ideas, the best score first; the first `most` of them for a report."""
    rows = reports.review_queue(hypotheses, product_ideas, key)
    return rows if most is None else rows.limit(most)


def edited(hypotheses: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """`hypotheses` with the reviewable fields of `updates` that are not null; reviewed marks those that were asked for.

    Of several updates of one id the last value of each field counts, in the order of `updates`.  Other columns of
    `updates` change nothing.  An unknown compliance status fails the query.
    """
    fields = [f for f in REVIEWABLE if f in updates.columns]
    status = F.col("compliance_status")
    known = F.when(status.isNull() | status.isin(*COMPLIANCE), status).otherwise(F.raise_error(F.concat(F.lit("unknown compliance status: "), status)))
    asked = updates.withColumn("compliance_status", known) if "compliance_status" in fields else updates
    placed = asked.select(key, *fields, F.monotonically_increasing_id().alias("__place"))
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("__place"))).alias(f"__{f}") for f in fields]
    new = placed.groupBy(key).agg(F.lit(True).alias("__asked"), *last)
    met = hypotheses.join(new, key, "left")
    held = {f: F.coalesce(f"__{f}", F.col(f) if f in hypotheses.columns else F.lit(None)) for f in fields}
    return met.withColumns(held).withColumn("reviewed", F.coalesce("__asked", F.lit(False))).drop(*[f"__{f}" for f in fields], "__asked")


def rescored(
    hypotheses: DataFrame, product_ideas: DataFrame, snapshots: DataFrame, weights: dict[str, float] | None = None, bands: tuple[tuple[str, float], ...] = BANDS
) -> DataFrame:
    """Ideas of reviewed `hypotheses` (edited) scored again, as reviewed, from the latest snapshot of their features.

    An idea without a snapshot is left out, and so is one of a hypothesis that nobody reviewed.
    """
    last = reports.latest(snapshots, "idea_id", "created_at", "id").select("idea_id", "features")
    parts = hypotheses.filter("reviewed").select(F.col("id").alias("hypothesis_id"), "buyer", "channel", "compliance_status", *[c for c in ("smallest_paid_test",) if c in hypotheses.columns])
    own = product_ideas.withColumnRenamed("smallest_paid_test", "idea_test")
    met = own.join(parts, "hypothesis_id").join(last, F.col("id") == F.col("idea_id"))
    test = F.coalesce("smallest_paid_test", "idea_test") if "smallest_paid_test" in hypotheses.columns else F.col("idea_test")
    flags = ("comparison_present", "budget_roi_present")
    feats = {f: (F.coalesce(F.col("features")[f], F.lit(0.0)) > 0 if f in flags else F.coalesce(F.col("features")[f], F.lit(0.0))) for f in FEATURES}
    keep = ["id", "hypothesis_id", "form"]
    return ideas.scored(met.select(*keep, "buyer", "channel", "compliance_status", test.alias("smallest_paid_test"), "features").withColumns(feats), weights, F.lit(True), bands)


def snapshots_of(scores: DataFrame, at: Column) -> DataFrame:
    """A snapshot for every idea scored again, changed or not."""
    name = F.concat(F.lit("snap_"), F.substring(F.sha2(F.concat_ws("|", "id", at.cast("string")), 256), 1, 12))
    return scores.select(name.alias("id"), F.col("id").alias("idea_id"), "features", "total", at.alias("created_at"))


def apply_review(store, updates: DataFrame, at: Column, weights: dict[str, float] | None = None, bands: tuple[tuple[str, float], ...] = BANDS) -> DataFrame:
    """Edit the store's hypotheses, score their ideas again, append snapshots; returns (id, score_total, band, failed_gates)."""
    from ..sources.scratch import Scratch

    scratch = Scratch(store.spark, "review")
    new = scratch.put(edited(store.scan("problem_hypothesis"), updates))
    held = store.scan("product_idea")
    scores = scratch.put(rescored(new, held, store.scan("score_snapshot"), weights, bands))
    store.replace("problem_hypothesis", new)
    changed = scores.select("id", F.col("score_total").alias("s"), F.col("band").alias("b"), F.col("failed_gates").alias("g"), F.lit(True).alias("again"))
    met = held.join(changed, "id", "left")
    again = F.coalesce("again", F.lit(False))
    store.replace("product_idea", met.withColumns({c: F.when(again, F.col(n)).otherwise(F.col(c)) for c, n in (("score_total", "s"), ("band", "b"), ("failed_gates", "g"))}))
    store.append("score_snapshot", snapshots_of(scores, at))
    return scores.select("id", "score_total", "band", "failed_gates")


def pack(labelled: DataFrame, claims: DataFrame, product_ideas: DataFrame, key: str) -> DataFrame:
    """What a reviewer reads of each hypothesis, as rows (key, kind, place, ref, text): its most urgent claims, first evidence, ideas by
    score, the 14 features recomputed, and whether it waits for a review."""
    rows = reports.evidence_pack(labelled, claims, key, PACK_CLAIMS, PACK_EVIDENCE)
    lines = labelled.select(F.col("id").alias("ref"), t.cut(F.concat_ws(" — ", "title"), PACK_CHARS).alias("text"))
    said = claims.select(F.col("evidence_id").alias("ref"), F.col("obstacle").alias("text")).groupBy("ref").agg(F.min("text").alias("text"))
    each = rows.filter("kind = 'evidence'").join(lines, "ref").unionByName(rows.filter("kind = 'claim'").join(said, "ref", "left"))
    scored = product_ideas.select(key, F.lit("idea").alias("kind"), F.row_number().over(_by_score(key)).alias("place"), F.col("form").alias("ref"), F.col("band").alias("text"))
    feats = ideas.features(labelled, claims, key)
    numbers = feats.select(key, F.posexplode(F.array(*[F.struct(F.lit(f).alias("ref"), F.col(f).cast("double").cast("string").alias("text")) for f in FEATURES])).alias("p", "f"))
    numbers = numbers.select(key, F.lit("feature").alias("kind"), (F.col("p") + 1).alias("place"), "f.ref", "f.text")
    waits = product_ideas.groupBy(key).agg(F.bool_or("awaiting_review").alias("w")).select(key, F.lit("awaiting").alias("kind"), F.lit(1).alias("place"), F.lit("review").alias("ref"), F.col("w").cast("string").alias("text"))
    out = each.select(key, "kind", "place", "ref", "text")
    for side in (scored, numbers, waits):
        out = out.unionByName(side)
    return out


def _by_score(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.col("score_total").desc(), "form")


def score_diff(rows: DataFrame, model: dict, weights: dict[str, float] | None = None) -> DataFrame:
    """Ideas (with hypothesis, form and feature columns) as the rubric and as a fitted ranker see them: total, learned (0 to 100), difference."""
    from .experiments import predicted

    flags = {c: F.col(c).cast("double") for c in ("comparison_present", "budget_roi_present") if c in rows.columns}
    learned = t.py_round(100 * predicted(rows, model), 1)
    scored = ideas.scored(rows, weights)
    return scored.withColumns({f"__{c}": x for c, x in flags.items()}).withColumn("learned", learned).withColumn("difference", F.col("learned") - F.col("score_total")).drop(*[f"__{c}" for c in flags])
