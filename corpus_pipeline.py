"""A training-corpus pipeline: each stage applies one corpus operator to all that the stage before it kept.

Every stage but the last returns the columns of documents.  Rows are told apart by doc_id and, where that is null or
repeats, by their other columns; texts move once a stage, those of rows that repeat twice.

Defined results, for every stage: null texts read as empty; a null doc_id is kept as null; rows that repeat are rows of
their own, but for near duplicates, of which one stays; an empty table stays empty; columns beyond those of documents
are left out.

The near-duplicate stage links fingerprints as op7 does (three-word shingles, three bits), which its contract fixes:
that finds texts that differ in few words of many, and leaves most pairs of a five-word similarity between 0.8 and 0.9.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oremill.llm import decontaminate, mixing, simhash, token_store, toxicity
from oremill.llm.common import Scratch, load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_held: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A stage's own tables, which `run` removes when the stage's result is written."""
    _held.append(Scratch(spark, name))
    return _held[-1]


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in COLUMNS if c in df.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay, null and empty texts (score 0) among them; the model learns from labelled
    documents outside fold 0 of 5, and without usable labels every document stays."""
    docs = _documents(docs)
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), _scratch(spark, "stage_toxicity"), ~toxicity.fold(F.col("doc_id"), 5, 0))
    return toxicity.score(docs, model).filter("score < 0.5").drop("score", "offending")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays: of the smallest doc_id, nulls last, the one with the shortest text."""
    docs, scratch = _documents(docs), _scratch(spark, "stage_simhash")
    # a row is known by its doc_id and a hash of all its columns, nulls told apart; rows alike in both are equal
    row = F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))])
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = scratch.put("fingerprints", simhash.fingerprinted(docs.withColumn("size", size).withColumn("row", row), "size", "row"))
    equal = rows.groupBy("fp", "doc_id", "size", "row").agg(F.count("*").alias("rows"))
    best = equal.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", "row", "rows")).alias("best"))
    named = simhash.named_components(rows, scratch)
    chosen = best.join(named, F.col("fp") == F.col("fp2")).groupBy("root").agg(F.min("best").alias("best"))
    chosen = chosen.select(F.col("best.doc_id").alias("chosen_id"), F.col("best.row").alias("chosen_row"), F.col("best.rows").alias("rows"))
    kept = docs.withColumn("row", row).join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("row") == F.col("chosen_row")))
    # of equal rows one is kept, by a first in each task and then one of those
    single, several = kept.filter("rows = 1"), kept.filter("rows > 1").dropDuplicates(["doc_id", "row"])
    return _documents(single).unionByName(_documents(several))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies inside benchmark windows stay, those without words among them."""
    docs = _documents(docs)
    found = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), _scratch(spark, "stage_decontaminate"), keep_text=True)
    return _documents(found.filter(~F.col("contaminated")))


ALIKE = ("doc_id", "source", "size", "digest")


def _met(left: DataFrame, right: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join on columns that may be null, which keeps those of `left`."""
    named = right.select(*[F.col(c).alias(f"p_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in on]
    return left.join(named, reduce(and_, same), how).drop(*[f"p_{c}" for c in on])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document, 0 to 2, as the mix takes; documents without words stand in the queue like others.

    A row alone in its doc_id, source, size and text is found by them.  Rows that repeat are numbered, by the part of the
    table each was read from and inside that, so that neither one task nor one window holds all copies.
    """
    docs, scratch = _documents(docs), _scratch(spark, "stage_mixing")
    plan = mixing.plan_mix(mixing.size_table(docs, scratch, by_text=True), scratch).select(*ALIKE, "n", "nth", "copies")
    held = docs.withColumn("size", mixing.n_words(F.col("text"))).withColumn("digest", F.xxhash64("text"))
    met = _met(held, plan.filter("n = 1 AND copies > 0").drop("n", "nth"), ALIKE)
    again = plan.filter("n > 1")
    if not again.isEmpty():
        parted = held.withColumn("part", F.spark_partition_id())
        repeated = scratch.put("repeated", _met(parted, again.filter("nth = 0").select(*ALIKE), ALIKE, "left_semi"))
        inside = F.row_number().over(Window.partitionBy(*ALIKE, "part").orderBy("lang", "n_chars"))
        earlier = Window.partitionBy(*ALIKE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = repeated.groupBy(*ALIKE, "part").agg(F.count("*").alias("rows")).withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
        numbered = _met(repeated.withColumn("inside", inside), offsets, (*ALIKE, "part")).withColumn("nth", F.col("offset") + F.col("inside") - 1)
        met = met.unionByName(_met(numbered, again.filter("copies > 0").drop("n"), (*ALIKE, "nth")).select(*met.columns))
    return _documents(met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified, read back from the token store, which stays."""
    return token_store.store_and_read(_documents(docs), Scratch(spark, "stage_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_store", write_tokens),
]
#: A learned score and a tokenizer are no SQL: the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for k, (name, stage) in enumerate(STAGES):
            docs = scratch.put(f"{k}-{name}", stage(spark, docs, sf_dir))
            while _held:
                _held.pop().clear()
            if k:
                scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
