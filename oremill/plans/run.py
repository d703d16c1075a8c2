"""The composed run: duplicates, claims, clusters, hypotheses, ideas, snapshots and draft experiments, with counters.

Every step is one plan over all verticals that the run covers; only `run_all` goes through verticals one by one, so that
one that fails does not keep the others from finishing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.pricing import price_band, priced_amounts
from ..functions.vocabulary import FEATURES
from ..operators import cluster, dedupe, ideas, policy
from ..settings import Rubric, Settings
from ..sources.payloads import natural_id
from ..sources.scratch import Scratch
from ..sources.store import Store, evidence_for_vertical

TOP_IDEAS = 3
TOP_CLUSTERS = 10


def marked(rows: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """`rows` (id, ord, vertical, content_hash, near_key_hash, embedding) with is_duplicate_of and dedupe_stage: exact, near, then semantic."""
    found = scratch.put(dedupe.duplicates(rows))
    if "embedding" not in rows.columns:
        return found
    left = dedupe.originals(found).select("ord", "embedding", "vertical")
    pairs = scratch.put(dedupe.similar_pairs(left, settings.semantic_threshold, "vertical"))
    links = dedupe.leaders_by_rounds(pairs, scratch.put).select(F.col("duplicate").alias("ord"), F.col("leader").alias("leader_ord"))
    names = rows.select(F.col("ord").alias("leader_ord"), F.col("id").alias("leader_id"))
    met = found.join(links.join(names, "leader_ord").select("ord", "leader_id"), "ord", "left")
    stage = F.coalesce("dedupe_stage", F.when(F.col("leader_id").isNotNull(), F.lit("semantic")))
    return met.withColumns({"is_duplicate_of": F.coalesce("is_duplicate_of", "leader_id"), "dedupe_stage": stage}).drop("leader_id")


def memberships(originals: DataFrame, rules: DataFrame, settings: Settings, clustered: DataFrame | None = None) -> DataFrame:
    """`originals` with hyp and cluster: the members of each vertical's ten largest clusters; where it has none, all of its rows.

    Rows are clustered where every source of the vertical may be aggregated; `clustered` (vertical, ord, cluster) stands
    in for that step.
    """
    if clustered is None:
        allowed = policy.gate_all(originals, rules, "vertical", "AGGREGATE").filter("allowed").select("vertical")
        if "embedding" not in originals.columns:
            clustered = originals.select("vertical", "ord", F.lit(None).cast("long").alias("cluster")).limit(0)
        else:
            clustered = cluster.clusters(originals.join(allowed, "vertical", "left_semi"), settings.cluster_threshold, "vertical", settings.dense_clusters)
    held = originals.join(clustered, ["vertical", "ord"], "left")
    kept = cluster.groups(held.filter("cluster IS NOT NULL"), "vertical", most=TOP_CLUSTERS).select("vertical", "cluster", "members")
    inside = held.join(F.broadcast(kept), ["vertical", "cluster"])  # at most ten rows a vertical
    without = held.join(F.broadcast(kept.select("vertical").distinct()), "vertical", "left_anti").withColumn("cluster", F.lit(None).cast("long")).withColumn("members", F.lit(None).cast("long"))
    name = F.concat("vertical", F.lit("/"), F.coalesce(F.col("cluster").cast("string"), F.lit("all")))
    return inside.unionByName(without).withColumn("hyp", name)


def analyse(
    rows: DataFrame, claims: DataFrame | None, rules: DataFrame, scratch: Scratch, settings: Settings = Settings(), rubric: Rubric = Rubric(), clustered: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All frames of a run over labelled evidence `rows`, by name; `claims` of a language model, or None for heuristic ones.

    counters has a row a vertical: originals, duplicates, claims, clusters, hypotheses, ideas, extraction_mode.
    """
    spark = scratch.spark
    found = scratch.put(marked(rows, settings, scratch))
    originals = scratch.put(dedupe.originals(found))
    member_rows = scratch.put(memberships(originals, rules, settings, clustered))
    # a row is in one cluster at most, so claims learn their vertical and hypothesis by one join and are stored once
    ids = member_rows.select("id", "hyp")
    place = scratch.put(originals.select("id", "vertical").join(ids, "id", "left").select(F.col("id").alias("evidence_id"), F.col("vertical").alias("of"), "hyp"))
    silent, cited = originals, None
    if claims is not None:
        cited = scratch.put(_whole_claims(claims.drop("of", "hyp")).join(place, "evidence_id"))
        silent = originals.join(cited.select("of").distinct(), F.col("vertical").eqNullSafe(F.col("of")), "left_anti")
    placed = scratch.put(_whole_claims(ideas.heuristic_claims(silent)).join(place, "evidence_id"))
    placed = placed if cited is None else cited.unionByName(placed, allowMissingColumns=True)
    own, keyed = placed.drop("of", "hyp"), placed.filter("hyp IS NOT NULL")
    hyps = scratch.put(ideas.hypotheses(member_rows, keyed, "hyp", policy.rights_clear(member_rows, rules, "hyp")))
    feats = scratch.put(ideas.features(member_rows, keyed, "hyp"))
    scored = ideas.scored(ideas.forms(hyps, spark).join(feats, "hyp"), rubric.weights, bands=rubric.bands)
    top = scratch.put(ideas.top_ideas(scored, "hyp", TOP_IDEAS).join(price_band(priced_amounts(keyed, ["hyp"], "price_signal"), ["hyp"]), "hyp", "left"))
    drafts = ideas.experiment_spec(top)
    of = member_rows.groupBy("hyp").agg(F.first("vertical").alias("vertical"), F.max("cluster").alias("cluster"), F.count("*").alias("members"))
    labels = cluster.labels(member_rows.filter("cluster IS NOT NULL"), "hyp")
    frames = {
        "marked": found, "originals": originals, "claims": own, "members": member_rows, "clusters": of.filter("cluster IS NOT NULL").join(labels, "hyp"),
        "hypotheses": hyps.join(of.select("hyp", "vertical", "cluster"), "hyp"), "links": ideas.evidence_links(member_rows, keyed, "hyp"),
        "features": feats, "ideas": top.join(of.select("hyp", "vertical"), "hyp"), "experiments": drafts,
    }
    return frames | {"counters": counters(frames)}


def _whole_claims(claims: DataFrame) -> DataFrame:
    """Claims with every column that later steps read."""
    kinds = {"persona": "string", "job": "string", "current_workaround": "string", "price_signal": "string", "incumbents": "array<string>", "urgency": "double", "model_version": "string"}
    return claims.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in claims.columns})


def counters(frames: dict[str, DataFrame]) -> DataFrame:
    """A row a vertical; its extraction_mode is llm where it has claims of a model, else heuristic."""
    per = frames["marked"].groupBy("vertical").agg(F.count_if(F.col("is_duplicate_of").isNull()).alias("originals"), F.count("is_duplicate_of").alias("duplicates"))
    where = frames["originals"].select(F.col("id").alias("evidence_id"), "vertical")
    sides = [
        frames["claims"].select("evidence_id", F.coalesce(F.col("model_version") != ideas.HEURISTIC, F.lit(True)).alias("said")).join(where, "evidence_id")
        .groupBy("vertical").agg(F.count("*").alias("claims"), F.bool_or("said").alias("said")),
        frames["clusters"].groupBy("vertical").agg(F.count("*").alias("clusters")),
        frames["hypotheses"].groupBy("vertical").agg(F.count("*").alias("hypotheses")),
        frames["ideas"].groupBy("vertical").agg(F.count("*").alias("ideas")),
    ]
    for side in sides:
        per = per.join(F.broadcast(side), "vertical", "left")  # a row a vertical
    return per.na.fill(0).withColumn("extraction_mode", F.when(F.coalesce("said", F.lit(False)), "llm").otherwise("heuristic")).drop("said")


# ---------------------------------------------------------------- over a store
def run(store: Store, slugs: list[str], rules: DataFrame, now: Column, settings: Settings = Settings(), rubric: Rubric = Rubric(), claims: DataFrame | None = None) -> DataFrame:
    """Analyse the evidence of `slugs`, write what is found to the store, and return the counters.

    Ids come from what makes a row itself, so that a second run over the same evidence writes the same rows again in
    place of the first one's.
    """
    scratch = Scratch(store.spark, "run")
    rows = store.scan("evidence_event", F.col("vertical").isin(*slugs))
    texts = F.concat_ws(" ", "title", "snippet")
    fresh = scratch.put(
        rows.withColumn("near_key_hash", t.key_hash(F.col("near_dup_key"))).drop("is_duplicate_of", "dedupe_stage", "intent_labels")
        .withColumn("__text", texts).withColumn("__fold", t.folded(F.col("__text")))
        .withColumn("intent_labels", t.intents(F.col("__text"), F.col("__fold"))).withColumn("priced", t.has_price_signal(F.col("__text"), F.col("__fold"))).drop("__text", "__fold")
    )
    ordered = scratch.put(fresh.join(_numbered(fresh), "id"))
    has_vectors = ordered.filter("size(embedding) > 0").limit(1).count()
    frames = analyse(ordered if has_vectors else ordered.drop("embedding"), claims, rules, scratch, settings, rubric)
    write(store, frames, slugs, now)
    return frames["counters"]


def _numbered(rows: DataFrame) -> DataFrame:
    """(id, ord): places in the order of fetched_at and id, by a range sort and offsets of its parts."""
    parts = rows.select("id", "fetched_at").repartitionByRange("fetched_at", "id").sortWithinPartitions("fetched_at", "id")
    return parts.select("id", F.monotonically_increasing_id().alias("ord"))


def write(store: Store, frames: dict[str, DataFrame], slugs: list[str], now: Column) -> None:
    """Labels and links back to the evidence; segments, claims, clusters, members, hypotheses, ideas, snapshots and drafts."""
    mine = F.col("vertical").isin(*slugs)
    found, others = frames["marked"], store.scan("evidence_event", ~mine)
    held = store.scan("evidence_event", mine).drop("is_duplicate_of", "dedupe_stage", "intent_labels")
    store.replace("evidence_event", others.unionByName(held.join(found.select("id", "is_duplicate_of", "dedupe_stage", "intent_labels"), "id"), allowMissingColumns=True))

    ids = store.scan("evidence_event", mine).select(F.col("id").alias("evidence_id"))
    segments = ideas.segments(store.scan("evidence_event", mine, F.col("is_duplicate_of").isNull()), F.col("snippet")).select(
        F.col("id").alias("evidence_id"), "ordinal", F.col("segment").alias("text")
    )
    _swap(store, "text_segment", segments.withColumn("id", natural_id("sg", F.col("evidence_id"), F.col("ordinal").cast("string"))), ids, "evidence_id")
    claims = frames["claims"].withColumn("id", natural_id("clm", F.col("evidence_id"), F.col("claim_type"), F.col("obstacle"))).withColumn("created_at", now)
    _swap(store, "pain_claim", claims, ids, "evidence_id")

    hyp = natural_id("hyp", F.col("hyp"))
    clusters = frames["clusters"].select(natural_id("cl", F.col("hyp")).alias("id"), "vertical", F.lit("greedy_cosine").alias("algorithm"), "label", F.col("members").alias("member_count"), now.alias("created_at"))
    old = store.scan("cluster", mine).select(F.col("id").alias("cluster_id"))
    _swap(store, "cluster_member", frames["members"].filter("cluster IS NOT NULL").select(natural_id("cl", F.col("hyp")).alias("cluster_id"), F.col("id").alias("evidence_id"), F.col("ord").alias("place")), old, "cluster_id")
    _swap(store, "cluster", clusters, mine)
    hypotheses = frames["hypotheses"].select(
        hyp.alias("id"), F.when(F.col("cluster").isNotNull(), natural_id("cl", F.col("hyp"))).alias("cluster_id"), "vertical", F.coalesce("pain", "hyp").alias("title"),
        "buyer", "job", "pain", "current_workaround", "current_paid_alternative", "incumbent_failures", "evidence_for", "evidence_against", "channel",
        "suggested_form", "pricing_mechanism", "compliance_status", now.alias("created_at"),
    )
    gone = store.scan("problem_hypothesis", mine).select(F.col("id").alias("hypothesis_id"))
    _swap(store, "hypothesis_evidence", frames["links"].withColumn("hypothesis_id", hyp), gone, "hypothesis_id")
    _swap(store, "problem_hypothesis", hypotheses, mine)

    idea = natural_id("idea", F.col("hyp"), F.col("form"))
    dims = F.create_map(*[x for d in ideas.dimensions() for x in (F.lit(d), F.col(d))])
    top = frames["ideas"].select(
        idea.alias("id"), hyp.alias("hypothesis_id"), "vertical", "form", "pitch", F.col("idea_pricing").alias("pricing_mechanism"), "smallest_paid_test", "mvp_sketch",
        "score_total", dims.alias("score_dimensions"), "failed_gates", "band", now.alias("created_at"),
    )
    _swap(store, "product_idea", top, mine)
    values = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f).cast("double"))])
    snaps = frames["ideas"].select(natural_id("snap", F.col("hyp"), F.col("form"), now.cast("string")).alias("id"), idea.alias("idea_id"), values.alias("features"), F.col("total").alias("total"), now.alias("created_at"))
    store.append("score_snapshot", snaps)
    spec = F.to_json(F.struct("economics_guardrail", "maximum_spend"))
    drafts = frames["experiments"].select(natural_id("exp", F.col("hyp"), F.col("form")).alias("id"), idea.alias("idea_id"), spec.alias("spec"), "status", now.alias("created_at"))
    store.append("experiment", drafts.join(store.scan("experiment").select("id"), "id", "left_anti"))


def _swap(store: Store, name: str, rows: DataFrame, gone: DataFrame | Column, key: str | None = None) -> None:
    """A new version with `rows` in place of those that `gone` names (a predicate, or a frame of keys)."""
    held = store.scan(name, ~gone) if key is None else store.scan(name).join(gone.distinct(), key, "left_anti")
    store.replace(name, held.unionByName(store.shaped(name, rows)))


@dataclass
class Batch:
    """Counters of the verticals that finished, and why the others did not (cut to 200 characters)."""

    results: dict[str, dict] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


def run_all(slugs: list[str], one: Callable[[str], DataFrame]) -> Batch:
    """`one` applied to each slug; a failure is noted and the next one goes on."""
    batch = Batch()
    for slug in slugs:
        try:
            batch.results[slug] = one(slug).first().asDict()
        except Exception as e:  # noqa: BLE001  the point is that whatever fails stays with its vertical
            batch.failed[slug] = f"{type(e).__name__}: {e}"[:200]
    return batch
