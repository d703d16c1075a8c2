"""Claims, features, hypotheses, forms, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vocabulary import BANDS, CLAIM_INTENTS, FAST_FORMS, FEATURES, FORMS, GROSS_MARGIN, PAYBACK_MONTHS, WEIGHTS
from .cluster import modes

HEURISTIC = "heuristic-0.2"
FEATURE_NAMES = FEATURES


def has(label: str) -> Column:
    return F.array_contains("intent_labels", label)


def any_of(labels) -> Column:
    return F.arrays_overlap("intent_labels", F.array(*map(F.lit, labels)))


def segments(rows: DataFrame, text: Column) -> DataFrame:
    return rows.select("id", F.posexplode(t.sentences(text)).alias("ordinal", "segment"))


def obstacle() -> Column:
    """What a row complains of: a title that asks, else the first sentence of its text, else its title."""
    title, snippet = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    return t.compress(F.when(F.endswith(title, F.lit("?")), title).when(snippet != "", snippet).otherwise(title))


def heuristic_claims(labelled: DataFrame) -> DataFrame:
    """One claim for each row that states a problem, asks for a feature or works around something.

    Rows that were stored without their texts have their obstacle as a column.
    """
    said = F.col("obstacle") if "obstacle" in labelled.columns else obstacle()
    return labelled.filter(any_of(CLAIM_INTENTS)).select(
        F.col("id").alias("evidence_id"), F.col("ord"), F.when(has("workaround"), "workaround").otherwise("pain").alias("claim_type"), said.alias("obstacle"),
        F.lit("problem_aware").alias("commercial_intent"), F.lit(0.4).alias("urgency"), F.lit(0.3).alias("confidence"), F.lit(HEURISTIC).alias("model_version"),
    )


def extracted(llm: DataFrame | None, labelled: DataFrame, block: str | None = None) -> DataFrame:
    """Claims of a language model where it gave any for known rows, else the heuristic ones: of each `block` by itself, if one is named."""
    if llm is None:
        return heuristic_claims(labelled)
    keys = [block] if block else []
    cited = llm.join(labelled.select(F.col("id").alias("evidence_id"), *[F.col(k).alias("__block") for k in keys]), "evidence_id")
    if not block:
        return cited if cited.limit(1).count() else heuristic_claims(labelled)
    answered = cited.select("__block").distinct()  # a row a block
    silent = labelled.join(answered, F.col(block).eqNullSafe(F.col("__block")), "left_anti")
    return cited.drop("__block").unionByName(heuristic_claims(silent), allowMissingColumns=True)


def last_claims(claims: DataFrame) -> DataFrame:
    w = Window.partitionBy("evidence_id").orderBy(F.col("ord").desc())
    return claims.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def features(rows: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """The 14 features of each key from `rows` (labelled) and `claims`; either side is aggregated before they meet."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    ev = rows.groupBy(key).agg(
        F.count("*").alias("unique_evidence_count"),
        F.count_distinct(F.nullif("domain", F.lit(""))).alias("unique_domain_count"),
        F.count_distinct("query_id").alias("unique_query_count"),
        F.count_distinct("source").alias("unique_source_count"),
        share(t.is_high_intent(F.col("intent_labels"))).alias("high_intent_share"),
        share(has("workaround")).alias("workaround_share"),
        share(has("switching")).alias("switching_share"),
        F.bool_or(has("comparison")).alias("comparison_present"),
        F.bool_or(has("budget_roi")).alias("budget_roi_present"),
        F.count_if(has("anti_demand")).alias("anti_demand_count"),
        F.count_if("priced").alias("row_price_signals"),
    )
    ev = ev.withColumns({c: t.py_round(c, 4) for c in ("high_intent_share", "workaround_share", "switching_share")})
    brands = claims.select(key, F.explode("incumbents").alias("b")).filter("b <> ''").groupBy(key).agg(F.count_distinct("b").alias("incumbent_count"))
    cl = claims.groupBy(key).agg(F.count_if(F.coalesce(F.col("price_signal") != "", F.lit(False))).alias("claim_price_signals"), F.max("urgency").alias("max_claim_urgency"), F.count("*").alias("claim_count"))
    none = {"claim_price_signals": 0, "incumbent_count": 0, "max_claim_urgency": 0.0, "claim_count": 0}
    met = ev.join(cl, key, "left").join(brands, key, "left").na.fill(none)
    return met.withColumn("explicit_price_signal_count", F.col("row_price_signals") + F.col("claim_price_signals")).drop("row_price_signals", "claim_price_signals")


def stance(rows: DataFrame, claims: DataFrame, evidence_key: str = "id") -> DataFrame:
    """`rows` with for_it (supports a hypothesis: states a need or has a claim) and against_it (says there is no demand)."""
    cited = claims.select(F.col("evidence_id").alias(evidence_key)).distinct().withColumn("cited", F.lit(True))
    against = has("anti_demand")
    pro = ~against & (any_of((*CLAIM_INTENTS, "solution_aware")) | F.coalesce("cited", F.lit(False)))
    return rows.join(cited, evidence_key, "left").withColumn("for_it", pro).withColumn("against_it", against).drop("cited")


def evidence_links(rows: DataFrame, claims: DataFrame, key: str, evidence_key: str = "id") -> DataFrame:
    """(key, side, place, evidence_id): the evidence of each hypothesis as rows, that for it before that against it, in order."""
    held = stance(rows, claims, evidence_key).filter("for_it OR against_it")
    side = F.when(F.col("for_it"), "for").otherwise("against")
    return held.select(key, side.alias("side"), F.col("ord").alias("place"), F.col(evidence_key).alias("evidence_id"))


def numbered_links(links: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """`links` with place from 1 on within each key, evidence for it first: counts of buckets of the order, then places inside each bucket.

    Buckets are ranges of the order column between its extremes, so no task sorts a whole key.
    """
    span = links.agg(F.min("place").alias("low"), F.max("place").alias("high")).first()
    low, width = span["low"] or 0, max(1, ((span["high"] or 0) - (span["low"] or 0)) // buckets + 1)
    order = (F.col("side") == "against").cast("long") * (buckets + 1) + F.floor((F.col("place") - low) / width)
    held = links.withColumn("bucket", order)
    counts = held.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = counts.select(key, "bucket", (F.sum("n").over(Window.partitionBy(key).orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("place", "evidence_id"))
    return held.withColumn("inside", inside).join(before, [key, "bucket"]).withColumn("place", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def hypotheses(rows: DataFrame, claims: DataFrame, key: str, rights_clear: DataFrame, evidence_key: str = "id") -> DataFrame:
    """One hypothesis a key: the modes of its claims, how much evidence is for and against it, channel, form and compliance.

    Which evidence that is stays in rows (evidence_links), since no key's evidence is bounded.
    """
    ev = stance(rows, claims, evidence_key).groupBy(key).agg(
        F.count_if("for_it").alias("evidence_for"), F.count_if("against_it").alias("evidence_against"),
        F.bool_or(t.is_high_intent(F.col("intent_labels")) | has("comparison")).alias("reachable"), F.bool_or(has("workaround")).alias("worked_around"),
    )
    names = claims.select(key, F.explode("incumbents").alias("b")).filter("b <> ''").groupBy(key).agg(F.array_sort(F.collect_set("b")).alias("incumbents"))
    some = claims.groupBy(key).agg(F.lit(True).alias("claimed"))
    met = ev
    for side in (modes(claims, key, ["persona", "job", "obstacle", "current_workaround"], F.col("ord")), names, some, rights_clear):
        met = met.join(side, key, "left")
    service = F.col("worked_around") | F.coalesce("claimed", F.lit(False))
    return met.select(
        key, F.col("persona").alias("buyer"), "job", F.col("obstacle").alias("pain"), "current_workaround",
        F.try_element_at("incumbents", F.lit(1)).alias("current_paid_alternative"),
        F.when(F.size("incumbents") > 0, F.concat(F.lit("recurring complaints/switching language around: "), F.array_join("incumbents", ", "))).alias("incumbent_failures"),
        "evidence_for", "evidence_against", F.when(F.col("reachable"), "search").alias("channel"),
        F.when(service, "productized_service").otherwise("software").alias("suggested_form"),
        F.when(service, "fixed_scope_pilot").otherwise("hybrid_base_plus_usage").alias("pricing_mechanism"),
        F.when(F.coalesce("rights_clear", F.lit(True)), "policy_ok_local_research").otherwise("rights_review_required").alias("compliance_status"),
    )


def forms(hypotheses: DataFrame, spark: SparkSession) -> DataFrame:
    """Each hypothesis in each of the fixed forms."""
    fixed = spark.createDataFrame([(i, *f) for i, f in enumerate(FORMS)], "form_ord int, form string, pitch string, idea_pricing string, smallest_paid_test string, mvp_sketch string")
    text = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    outcome = F.concat(F.lit("handles: "), text("job", "the recurring job"), F.lit(" — "), text("pain", "removes the manual work"))
    pitch = F.replace(F.replace("pitch", F.lit("{outcome}"), outcome), F.lit("{incumbent}"), text("current_paid_alternative", "A->B"))
    return hypotheses.join(F.broadcast(fixed)).withColumn("pitch", pitch)  # six constant rows


def dimensions() -> dict[str, Column]:
    """The ten dimensions over features, hypothesis and form columns, each between 0 and 10 (formulas and constants: fixed values)."""
    n = lambda c: F.col(c).cast("double")
    yes = lambda c, points, other=0: F.when(F.coalesce(c, F.lit(False)), float(points)).otherwise(float(other))
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    raw = {
        "pain_severity": 6 * n("max_claim_urgency") + 4 * n("workaround_share"),
        "commercial_intent": 10 * n("high_intent_share"),
        "demand_breadth": 0.5 * n("unique_evidence_count") + n("unique_domain_count"),
        "wtp_proxy": 3 + 2 * F.least(n("explicit_price_signal_count"), F.lit(3.0)) + yes(F.col("incumbent_count") > 0, 2),
        "competitive_gap": F.when(F.col("incumbent_count") == 0, 4.0).otherwise(F.greatest(8 - n("incumbent_count"), F.lit(3.0))) + yes(F.col("switching_share") > 0, 2),
        "buyer_reachability": yes(filled("buyer"), 6, 2) + yes(filled("channel"), 2) + yes(F.col("comparison_present"), 1),
        "repeatability": 4 + yes(F.col("workaround_share") > 0.25, 4) + yes(F.col("budget_roi_present"), 2),
        "compliance_rights": yes(F.col("compliance_status") == "policy_ok_local_research", 10),
        "mvp_speed": yes(F.col("form").isin(*FAST_FORMS), 8, 5),
        "unit_economics": 5 + yes(F.col("explicit_price_signal_count") > 0, 2),
    }
    return {k: t.clamp(v) for k, v in raw.items()}


def gates() -> dict[str, Column]:
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return {"buyer_identified": filled("buyer"), "channel_identified": filled("channel"), "payment_test_defined": filled("smallest_paid_test"), "rights_clear": F.col("compliance_status") == "policy_ok_local_research"}


def scored(rows: DataFrame, weights: dict[str, float] | None = None, reviewed: Column | None = None, bands: tuple[tuple[str, float], ...] = BANDS) -> DataFrame:
    """`rows` with dimensions, total (unrounded), score_total, failed_gates, band and awaiting_review.

    `weights` are keyed by dimension, `bands` are names and floors, the highest first; without review no idea gets
    beyond the interview band.
    """
    weights, dims, reviewed = weights or WEIGHTS, dimensions(), F.lit(False) if reviewed is None else reviewed
    out = rows.withColumns(dims)
    total = sum((F.col(d) * float(weights.get(d, 0)) for d in dims), F.lit(0.0)) / 10
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in gates().items()]))
    out = out.withColumn("total", total).withColumn("failed_gates", failed)
    reached = F.coalesce(*[F.when(F.col("total") >= floor, F.lit(name)) for name, floor in bands], F.lit("archive"))
    capped = F.when((F.size("failed_gates") > 0) & reached.isin("paid_validation", "interview"), "collect_more").otherwise(reached)
    waits = (capped == "paid_validation") & ~reviewed
    return out.withColumn("score_total", t.py_round("total", 1)).withColumn("awaiting_review", waits).withColumn("band", F.when(waits, "interview").otherwise(capped))


def top_ideas(ideas: DataFrame, key: str, k: int = 3) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("total").desc(), "form_ord")
    return ideas.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def experiment_spec(ideas: DataFrame) -> DataFrame:
    """Draft economics from the evidence's median price: a whole price, half up, and the spend cap that follows."""
    price = t.half_up(F.col("median_monthly")).cast("double")
    cap = t.cac_ceiling(price, F.lit(GROSS_MARGIN), F.lit(PAYBACK_MONTHS))
    number = lambda c: F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")
    source = F.format_string("derived:median(n=%d,p25=%s,p75=%s)", F.col("n"), number(F.col("p25")), number(F.col("p75")))
    guard = F.struct(price.alias("price_monthly"), F.when(price.isNotNull(), source).alias("price_provenance"), F.lit(GROSS_MARGIN).alias("gross_margin"), F.lit(PAYBACK_MONTHS).alias("cac_payback_months"), cap.alias("cac_ceiling"))
    return ideas.withColumn("economics_guardrail", guard).withColumn("maximum_spend", cap).withColumn("status", F.lit("draft"))
