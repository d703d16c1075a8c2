"""Experiment life cycle, economics, decisions, outcome import, and the calibration of a ranker on outcomes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FitRefused, LabelDiversityError, LeakageError
from ..functions import text as t
from ..functions.vocabulary import DECISION_STATUS, FEATURES, MOVES, OUTCOME_KINDS, PAID_KINDS, READY_OUTCOMES
from ..sources.scratch import Scratch


def may_move(current: Column, target: Column) -> Column:
    legal = F.lit(False)
    for a, b in MOVES:
        legal = legal | ((current == a) & (target == b))
    return F.coalesce(legal, F.lit(False))


def economics_problem(price: Column, provenance: Column, margin: Column, months: Column, cap: Column, spend: Column) -> Column:
    """Why an experiment may not start, or null: a finite positive price of known provenance, and caps that follow from it."""
    expected = t.cac_ceiling(price, margin, months)
    drifts = lambda c: F.coalesce(~t.is_close(c, expected), F.lit(False))
    return (
        F.when(price.isNull(), "no price")
        .when(F.isnan(price) | (price <= 0) | (price == float("inf")), "price not finite and positive")
        .when(~F.coalesce(F.length(provenance) > 0, F.lit(False)), "no provenance")
        .when(cap.isNotNull() & drifts(cap), "cac_ceiling drifted")
        .when(cap.isNotNull() & drifts(spend), "maximum_spend drifted")
    )


def started(experiments: DataFrame, requests: DataFrame, on: Column) -> DataFrame:
    """`experiments` (id, status, price, provenance, margin, months, cap, spend) after `requests` (id, price, or null to keep the draft's) to start them.

    A price given by an operator takes the draft's place, with the caps that follow from it and the operator and day as
    its provenance.  A refused request changes nothing and says why in `refusal`; rows without a request have none.
    Of several requests for one id the last one counts, in the order of `requests`.
    """
    placed = requests.select(F.col("id").alias("asked"), F.struct(F.monotonically_increasing_id().alias("place"), "price").alias("r"))
    asked = placed.groupBy("asked").agg(F.max("r").alias("r")).select("asked", F.col("r.price").alias("own_price"))
    met = experiments.join(asked, F.col("id") == F.col("asked"), "left")
    own = F.col("own_price").isNotNull()
    price = F.coalesce("own_price", "price")
    cap = F.when(own, t.cac_ceiling(price, F.col("margin"), F.col("months"))).otherwise(F.col("cap"))
    spend = F.when(own, t.cac_ceiling(price, F.col("margin"), F.col("months"))).otherwise(F.col("spend"))
    source = F.when(own, F.concat(F.lit("reviewed:operator "), F.date_format(on, "yyyy-MM-dd"))).otherwise(F.col("provenance"))
    problem = F.when(~may_move(F.col("status"), F.lit("running")), "illegal transition").otherwise(economics_problem(price, source, F.col("margin"), F.col("months"), cap, spend))
    out = met.withColumn("refusal", F.when(F.col("asked").isNotNull(), problem))
    good = F.col("asked").isNotNull() & F.col("refusal").isNull()
    new = {"status": F.lit("running"), "price": price, "provenance": source, "cap": cap, "spend": spend}
    return out.select(*[F.when(good, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in experiments.columns], "refusal")


def stopped(experiments: DataFrame, requests: DataFrame) -> DataFrame:
    """`experiments` after `requests` (id) to stop them; only running ones can be."""
    met = experiments.join(requests.select(F.col("id").alias("asked")).distinct(), F.col("id") == F.col("asked"), "left")
    asked, legal = F.col("asked").isNotNull(), may_move(F.col("status"), F.lit("stopped"))
    out = met.withColumn("refusal", F.when(asked & ~legal, "illegal transition")).withColumn("status", F.when(asked & legal, "stopped").otherwise(F.col("status")))
    return out.drop("asked")


def decide(experiments: DataFrame, outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """`decisions` (experiment_id, decision, reason) applied: refusals, warnings, the new status and the outcome that is added."""
    kinds = outcomes.groupBy("experiment_id").agg(F.bool_or(F.col("kind").isin(*PAID_KINDS)).alias("paid"))
    target = F.element_at(F.create_map(*[F.lit(x) for kv in DECISION_STATUS.items() for x in kv]), F.col("decision"))
    met = decisions.join(experiments.select(F.col("id").alias("experiment_id"), "status"), "experiment_id", "left").join(kinds, "experiment_id", "left")
    refusal = (
        F.when(~F.coalesce(F.col("decision").isin(*DECISION_STATUS), F.lit(False)), "unknown decision")
        .when(F.col("status").isNull(), "unknown experiment")
        .when((F.col("status") != target) & ~may_move(F.col("status"), target), "illegal transition")
    )
    reason = F.substring(F.coalesce("reason", F.lit("")), 1, 500)
    out = met.withColumn("refusal", refusal)
    ok = F.col("refusal").isNull()
    return out.select(
        "experiment_id", "decision", "refusal", F.when(ok, target).otherwise(F.col("status")).alias("new_status"), F.when(ok, reason).alias("decision_reason"),
        F.coalesce(ok & (F.col("decision") == "advance") & ~F.coalesce("paid", F.lit(False)), F.lit(False)).alias("unpaid_warning"),
        F.when(ok & ((F.col("decision") != "iterate") | (reason != "")), F.col("decision")).alias("outcome_kind"),
    )


def import_refusals(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """`rows` (experiment_id, kind, value) with the first reason to refuse each, or null; a blank value is an empty object."""
    value = F.when(F.btrim(F.coalesce("value", F.lit(""))) == "", "{}").otherwise(F.col("value"))
    parsed = F.try_parse_json(value)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    known = experiments.select(F.col("id").alias("experiment_id"), F.col("status").alias("experiment_status"))
    met = rows.join(known, "experiment_id", "left")
    target = F.element_at(F.create_map(*[F.lit(x) for kv in DECISION_STATUS.items() for x in kv]), F.col("kind"))
    malformed = F.col("malformed").isNotNull() if "malformed" in rows.columns else F.lit(False)
    refusal = (
        F.when(F.col("experiment_id").isNull() | F.col("kind").isNull() | malformed, "wrong number of columns")
        .when(~F.col("kind").isin(*OUTCOME_KINDS), "unknown kind")
        .when(parsed.isNull(), "value is not JSON")
        .when(~is_object, "value is not an object")
        .when(t.carries_text(value), "value carries source text")
        .when(F.col("experiment_status").isNull(), "unknown experiment")
        .when(target.isNotNull() & (target != F.col("experiment_status")) & ~may_move(F.col("experiment_status"), target), "illegal transition")
    )
    return met.withColumn("refusal", refusal)


def accepted(checked: DataFrame, keep_going: bool = False) -> DataFrame:
    """Rows to write: all or nothing, unless keep_going."""
    good = checked.filter("refusal IS NULL")
    return good if keep_going or not checked.filter("refusal IS NOT NULL").limit(1).count() else good.limit(0)


# ---------------------------------------------------------------- calibration
def calibration_rows(snapshots: DataFrame, experiments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each snapshot with its idea's last decision and the outcomes reached through its experiments, and how many differ."""
    exp = experiments.select(F.col("id").alias("experiment_id"), "idea_id", "created_at", "decision")
    per = exp.join(outcomes.select("experiment_id", F.col("id").alias("outcome_id"), "kind"), "experiment_id", "left")
    by_idea = per.groupBy("idea_id").agg(F.count_distinct("outcome_id").alias("outcomes"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    last = exp.groupBy("idea_id").agg(F.max_by("decision", F.when(F.col("decision").isNotNull(), F.struct("created_at", "experiment_id"))).alias("decision"))
    return snapshots.join(by_idea, "idea_id", "left").join(last, "idea_id", "left").na.fill({"outcomes": 0})


def leakage(outcomes: DataFrame) -> DataFrame:
    """Outcomes whose value carries source text, which no calibration may learn from."""
    return outcomes.filter(t.carries_text(F.coalesce("value", F.lit("{}"))))


def calibration_dataset(snapshots: DataFrame, experiments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """calibration_rows, refused if any outcome leaks text: the first offender, by id, is named."""
    first = leakage(outcomes).orderBy("id").select("id").first()
    if first:
        raise LeakageError(f"outcome {first['id']} carries source text")
    return calibration_rows(snapshots, experiments, outcomes)


def decision_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("decision").agg(F.count("*").alias("n"))


def ready(outcomes_reached: Column) -> Column:
    return outcomes_reached >= READY_OUTCOMES


def encoded(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("decision").isNotNull()).withColumn("label", F.when(F.col("decision") == "advance", 1).otherwise(0))


def moments(rows: DataFrame, features) -> DataFrame:
    """feature, mean and population deviation, in one pass; constant features are marked as dropped."""
    aggs = [F.struct(F.lit(f).alias("feature"), F.avg(F.col(f).cast("double")).alias("mean"), F.stddev_pop(F.col(f).cast("double")).alias("std")) for f in features]
    return rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("m")).select("m.*").withColumn("dropped", F.col("std") < 1e-9)


BLOCK_ROWS = 1 << 16


def _blocks(width: int):
    """Rows of doubles packed to blocks of at most BLOCK_ROWS, so that a round of the descent reads arrays and no rows."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(np.concatenate(held)).tobytes()], pa.binary())], names=["rows"])
        for batch in batches:
            held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)]))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield pack()
                held, n = [], 0
        if n:
            yield pack()

    return run


def _sums(block: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Of a block (features, label, count): the log loss, the gradient of the weights and that of the intercept, as sums."""
    x, y, k = block[:, : len(w)], block[:, -2], block[:, -1]
    p = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60)))
    error = k * (p - y)
    loss = -(k * (y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))).sum()
    return np.concatenate([[loss], x.T @ error, [error.sum()]])


def _round(blocks: DataFrame, width: int, w: np.ndarray, b: float) -> np.ndarray:
    """The sums of all blocks, by one pass over them on the cluster; a row a partition comes back."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(w) + 2)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += _sums(np.frombuffer(raw).reshape(-1, width), w, b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return np.sum([np.frombuffer(bytes(r["sums"])) for r in blocks.mapInArrow(run, "sums binary").collect()], axis=0)


def fit_logistic(rows: DataFrame, features=FEATURES, l2: float = 0.01, rounds: int = 4000, tolerance: float = 1e-7, put=None) -> dict:
    """Standardised logistic regression by full-batch descent with early stopping, the same at every size.

    Equal feature rows are counted as one and packed to blocks.  A single block (BLOCK_ROWS distinct rows) is descended
    on the driver; of more, each round is one aggregation of len(features) + 2 sums over the cluster.  `put` stores the
    blocks (default: a scratch table).
    """
    m = {r["feature"]: r for r in moments(rows, features).collect()}
    used = [f for f in features if m[f]["std"] is not None and not m[f]["dropped"]]
    z = [((F.col(f).cast("double") - m[f]["mean"]) / m[f]["std"]).alias(f"z{i}") for i, f in enumerate(used)]
    data = rows.select(*z, F.col("label").cast("double").alias("y")).groupBy(*[f"z{i}" for i in range(len(used))], "y").agg(F.count("*").cast("double").alias("k"))
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if n < 2 or not ones or ones == n:
        raise LabelDiversityError("both classes are needed")
    width = len(used) + 2
    put = put or Scratch(rows.sparkSession, "fit").put
    blocks = put(data.mapInArrow(_blocks(width), "rows binary"))
    few = blocks.agg(F.sum(F.octet_length("rows"))).first()[0] // (8 * width) <= BLOCK_ROWS
    alone = np.concatenate([np.frombuffer(bytes(r["rows"])).reshape(-1, width) for r in blocks.collect()]) if few else None
    w, b, before = np.zeros(len(used)), 0.0, np.inf
    for done in range(1, rounds + 1):
        sums = _sums(alone, w, b) if few else _round(blocks, width, w, b)
        loss = sums[0] / n + l2 * (w @ w)
        if not np.isfinite(loss):
            raise FitRefused("the loss is not a number")
        if abs(before - loss) < tolerance:
            break
        before = loss
        w = w - 0.5 / n * (sums[1:-1] + 2 * l2 * n * w)
        b -= 0.5 / n * sums[-1]
    weights = {f: float(w[used.index(f)]) if f in used else 0.0 for f in features}
    scales = {"means": {f: m[f]["mean"] for f in used}, "stds": {f: m[f]["std"] for f in used}}
    return {"features": list(features), "weights": weights, "intercept": float(b), **scales, "loss": float(loss), "rounds": done, "n": int(n)}


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), score))))


def parse_l2(text: str | float | None, default: float = 0.01) -> float:
    """A penalty from a command line: finite and not negative."""
    if text is None or text == "":
        return default
    value = float(text)
    if not np.isfinite(value) or value < 0:
        raise FitRefused(f"the penalty {text!r} is not a number from 0 on")
    return value


def predicted(rows: DataFrame, model: dict) -> Column:
    score = F.lit(model["intercept"])
    for f in model["means"]:
        score = score + model["weights"][f] * (F.col(f).cast("double") - model["means"][f]) / model["stds"][f]
    return sigmoid(score)


def rescore(snapshots: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The latest snapshot of each key with an operator's non-null fields in place of the old ones."""
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc())
    last = snapshots.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
    new = updates.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("touched"))
    met = last.join(new, key, "left")
    return met.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*[f"new_{f}" for f in fields])
