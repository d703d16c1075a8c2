"""The evidence model over the driver's tables: one function a view, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vocabulary import RIGHT_NAMES, RIGHTS
from ..operators.ideas import obstacle
from .scratch import Scratch

VERTICALS = ("alpha", "beta", "gamma")
SOURCES = tuple(RIGHTS)
TITLES = (
    "How do I stop manual spreadsheet imports?", "Best alternative to Zapier for small teams", "pricing is $19 per month for the subscription",
    "we migrated because it was too expensive", "saves 10 hours per week, real ROI", "wish there was a tool for weekly reports",
    "the free tool is good enough, solved it", "software that automates invoices", "X vs Y compared to doing it by hand", "why doesn't it export to excel",
    "How much does a license cost at $49/mo?", "cancel and switch to a replacement for BigTool", "painful and annoying: takes forever",
    "need a tool instead of copy-paste", "Company homepage and contact page", "$99 per year, worth paying for",
)
PRICE_SUFFIXES = ("/mo", " per year", " one-time", " monthly")


def pick(values, index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    rows = d.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("ev_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"),
        pick(VERTICALS, F.col("doc_id")).alias("vertical"),
        F.concat(F.lit("q_"), F.col("doc_id") % 25).alias("query_id"),
        pick(SOURCES, number).alias("source"),
        F.concat(F.lit("https://www.example.com/"), "lang", F.lit("/"), F.col("doc_id") % 3, F.lit("?utm_source="), "source").alias("url"),
        F.concat("source", F.lit(".example.com")).alias("domain"),
        pick(TITLES, F.col("n_chars")).alias("title"),
        F.coalesce("text", F.lit("")).alias("snippet"),
        F.col("lang").alias("language"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("fetched_at"),
    )
    return rows.withColumn("canonical_url", t.canonical_url(F.col("url")))


def hashed(ev: DataFrame) -> DataFrame:
    return ev.withColumn("content_hash", t.content_hash(F.col("canonical_url"), F.col("title"), F.col("snippet"))).withColumn("near_dup_key", t.near_key(F.concat_ws(" ", "title", "snippet")))


def labelled(ev: DataFrame) -> DataFrame:
    """`ev` with intent_labels and priced; the folded text is a column of its own, so that it is made once a row."""
    folds = ev.withColumn("__text", F.concat_ws(" ", "title", "snippet")).withColumn("__fold", t.folded(F.col("__text")))
    text, fold = F.col("__text"), F.col("__fold")
    return folds.withColumn("intent_labels", t.intents(text, fold)).withColumn("priced", t.has_price_signal(text, fold)).drop("__text", "__fold")


def keyed(ev: DataFrame) -> DataFrame:
    """`ev` with what duplicates are found by, without its text: content_hash and a hash of the near-duplicate key."""
    return hashed(ev).withColumn("near_key_hash", t.key_hash(F.col("near_dup_key"))).drop("near_dup_key")


class Stored:
    """The evidence and claims of one run, written once without their texts, so that a query scans documents once."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, hashes: bool = False, labels: bool = True):
        self.spark, self.sf_dir, self.scratch = spark, sf_dir, Scratch(spark, name)
        self.hashes, self.labels = hashes, labels
        self._evidence = self._claims = None

    @property
    def evidence(self) -> DataFrame:
        if self._evidence is None:
            rows = evidence(self.spark, self.sf_dir)
            rows = keyed(rows) if self.hashes else rows
            rows = labelled(rows.withColumn("obstacle", obstacle())) if self.labels else rows
            self._evidence = self.scratch.put(rows.drop("snippet", "url"))
        return self._evidence

    @property
    def claims(self) -> DataFrame:
        if self._claims is None:
            self._claims = self.scratch.put(claims(self.spark, self.sf_dir))
        return self._claims


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part"))
    doc = F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return (
        li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
            F.concat(F.lit("ev_"), F.lpad(doc.cast("string"), 8, "0")).alias("evidence_id"),
            pick(VERTICALS, doc).alias("vertical"),
            F.when(F.col("l_returnflag") == "R", "switching").otherwise("pain").alias("claim_type"),
            F.col("c_mktsegment").alias("persona"),
            F.col("p_type").alias("job"),
            F.col("p_name").alias("obstacle"),
            F.when(F.col("l_linestatus") == "O", "spreadsheet").alias("current_workaround"),
            F.concat(F.lit("$"), F.floor("p_retailprice").cast("string"), pick(PRICE_SUFFIXES, F.col("l_linenumber"))).alias("price_signal"),
            F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("urgency"),
            F.array("p_brand").alias("incumbents"),
        )
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("P", "draft", "O", "running", "F", "stopped")]), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("exp_"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("idea_"), "o_custkey").alias("idea_id"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("spend"), F.col("o_orderpriority").alias("priority"),
    )


def ideas_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("idea_"), "c_custkey").alias("id"), pick(VERTICALS, F.col("c_custkey")).alias("vertical"), F.col("c_acctbal").alias("balance"))


KINDS = {"signup": "email_signup", "purchase": "payment_received", "click": "demo_request", "view": "price_shown_interest", "error": "kill"}


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes; an event's experiment is the order of the same number, where there is one."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("out_"), "event_id").alias("id"), F.col("event_id").alias("ord"), F.concat(F.lit("exp_"), "event_id").alias("experiment_id"), kind.alias("kind"), F.col("props").alias("value"), F.col("ts").alias("observed_at")
    )


def policies(spark: SparkSession) -> DataFrame:
    rows = [(name, *r) for name, r in RIGHTS.items()]
    return spark.createDataFrame(rows, "source string, enabled boolean, " + ", ".join(f"{n} boolean" for n in RIGHT_NAMES) + ", authorised boolean, retention_days int")
