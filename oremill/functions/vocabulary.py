"""Values that results depend on and that are fixed by the data model: patterns, word lists, forms, rights, weights."""

from __future__ import annotations

# --- fixed values: intent families, in output order, and their case-insensitive patterns
INTENTS = {
    "problem_aware": r"\bhow do i\b|\bhow to\b|\bwhy does\b|\bwhy is\b|\btakes? forever\b|\bmanual(ly)?\b|\bstruggl\w*\b|\bpainful\b|\bannoying\b|\bfrustrat\w*\b",
    "workaround": r"\bspreadsheet\b|\bexcel\b|\bzapier\b|\bmacro\b|\bscript i wrote\b|\bcopy.?paste\b|\bworkaround\b|\bduct.?taped?\b|\bby hand\b|\bmanual(ly)?\b",
    "solution_aware": r"\btool for\b|\bsoftware that\b|\bapp that\b|\bautomat\w+\b|\bcli for\b|\bplugin for\b|\bservice that\b",
    "comparison": r"\bvs\.?\b|\bversus\b|\balternative to\b|\bbest \w+ for\b|\bcompared? to\b|\binstead of\b|\breplacement for\b",
    "transactional": r"\bpric\w+\b|\bcost\b|\bhow much\b|\bbuy\b|\btrial\b|\bsubscription\b|\bper month\b|\$/mo\b|\blicen[cs]e\b|\bquote\b",
    "switching": r"\bmigrat\w+\b|\bmove (off|from|away)\b|\bcancel\w*\b|\bswitch (from|to)\b|\btoo expensive\b|\bdropped\b|\breplac\w+\b",
    "budget_roi": r"\$\s?\d[\d,.]*\b|\bhours (a|per) week\b|\bheadcount\b|\broi\b|\bcost us\b|\bsaves? \d+\b|\bworth paying\b",
    "feature_request": r"\bwish (it|there)\b|\bdoes anyone know\b|\bany way to\b|\blooking for (a )?(way|tool)\b|\bneed (a )?tool\b|\bwhy (isn'?t|doesn'?t)\b",
    "anti_demand": r"\bsolved\b|\bnot worth\b|\bfree tool\b|\boverkill\b|\bjust use\b|\bgood enough\b|\bworks fine\b",
}
HIGH_INTENT = ("solution_aware", "comparison", "transactional", "switching")
CLAIM_INTENTS = ("problem_aware", "feature_request", "workaround")
PRICE_SIGNAL = r"\$\s?\d[\d,.]*|\bper month\b|\b/mo\b|\bpricing\b|\bsubscription\b|\b_paid\b"

# --- fixed values: price grammar
PERCENT = r"\d+(?:\.\d+)?\s?%"
MONEY = r"\$\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
MONTH = r"\bmonth(?:ly)?\b|/mo\b"
YEAR = r"\byear(?:ly)?\b|/yr\b|/year\b|\bannually\b|\bannual\b|\bper annum\b"
FREE = r"\bfree\b"
NOT_AN_OFFER = r"\bbudget(?:s|ed|ing)?\b|\bcosts?\s+(?:us|me|them|our|my)\b|\bwast(?:e|es|ed|ing)\b|\bsav(?:e|es|ed|ing|ings)\b|\bworth\b|\blos(?:e|es|ing|t)\b"
MARKER_REACH = 20
MOST_MONTHLY = 2500.0

# --- fixed values: words that never label a cluster
STOP_WORDS = (
    "the a an and or for to of in on with how do i is are my your it that this be can you best get using use from at when what why not but if into than then "
    "will should does free vs com www https http"
).split()

# --- fixed values: URL parameters that only track
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer")

# --- fixed values: product forms (form, pitch, pricing mechanism, smallest paid test, sketch)
FORMS = (
    ("software", "Software that {outcome}", "hybrid_base_plus_usage", "Landing page with visible price + refundable deposit", "Single-workflow wedge app with checkout on the core loop"),
    ("productized_service", "Done-for-you service that {outcome}", "fixed_scope_pilot", "2-week fixed-scope paid pilot sold on the outcome", "Checklist + internal tools; human fulfillment, exceptions logged"),
    ("template_info_product", "Template/playbook that {outcome}", "one_time", "Preorder page for the template pack", "Documented workflow + spreadsheet/notion system"),
    ("integration", "One-click {incumbent} integration that {outcome}", "per_connection_subscription", "Paid beta for 5 users of the exact X->Y sync", "Narrow X->Y sync with exception queue"),
    ("managed_workflow", "Managed workflow that {outcome} every week", "monthly_retainer", "First month retainer, outcome-guaranteed", "Scheduled pipeline + human review step"),
    ("marketplace", "Marketplace matching buyers who need {outcome}", "take_rate", "Manually broker 3 transactions, take a cut", "Concierge brokerage over email/spreadsheet"),
)
FAST_FORMS = ("productized_service", "template_info_product", "managed_workflow")

# --- fixed values: dimension weights and band floors
WEIGHTS = {
    "pain_severity": 15, "commercial_intent": 15, "demand_breadth": 10, "wtp_proxy": 10, "competitive_gap": 10,
    "buyer_reachability": 10, "repeatability": 10, "compliance_rights": 10, "mvp_speed": 5, "unit_economics": 5,
}
BANDS = (("paid_validation", 80.0), ("interview", 70.0), ("collect_more", 55.0))
FEATURES = (
    "unique_evidence_count", "unique_domain_count", "unique_query_count", "unique_source_count", "high_intent_share", "workaround_share", "switching_share",
    "comparison_present", "budget_roi_present", "anti_demand_count", "explicit_price_signal_count", "incumbent_count", "max_claim_urgency", "claim_count",
)

# --- fixed values: rights by source (enabled, collect, store_derived, store_raw, aggregate, local, external, training, redisplay, commercial, deletion, authorised, retention days)
RIGHTS = {
    "searxng": (True, True, True, False, True, True, True, False, False, False, False, True, 180),
    "google_ads": (False, False, True, False, True, True, False, False, False, False, True, False, 365),
    "serp_provider": (False, False, True, False, True, True, False, False, False, False, True, False, 180),
    "youtube": (False, False, False, False, False, False, False, False, False, False, True, False, 90),
    "reddit": (False, False, False, False, False, False, False, False, False, False, True, False, 90),
    "web_crawler": (False, False, True, False, True, True, False, False, False, False, False, False, 120),
}
RIGHT_NAMES = ("collect_enabled", "store_derived", "store_raw", "aggregate", "local_inference", "external_inference", "model_training", "redisplay_raw_content", "commercial_use", "deletion_propagates")
PURPOSES = {
    "COLLECT": "collect_enabled", "STORE_DERIVED": "store_derived", "STORE_RAW": "store_raw", "AGGREGATE": "aggregate",
    "LOCAL_INFERENCE": "local_inference", "EXTERNAL_INFERENCE": "external_inference", "TRAINING": "model_training", "REDISPLAY": "redisplay_raw_content",
}

# --- fixed values: experiments
OUTCOME_KINDS = (
    "email_signup", "interview_completed", "demo_request", "price_shown_interest", "deposit_paid", "paid_pilot_started", "payment_received",
    "activation", "retention_60d", "cac_observed", "advance", "kill", "iterate",
)
PAID_KINDS = ("deposit_paid", "paid_pilot_started", "payment_received")
MOVES = (("draft", "running"), ("running", "stopped"))
DECISION_STATUS = {"advance": "stopped", "kill": "stopped", "iterate": "running"}
GROSS_MARGIN, PAYBACK_MONTHS = 0.85, 6
EVIDENCE_ID = r"\bev_[0-9a-f]{6,}\b"
READY_OUTCOMES = 30
