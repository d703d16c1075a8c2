"""Queries on streams that carry state: leaders, keys seen in earlier runs, retention by timers; with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage
from ..sources import views as v
from ..sources.keyindex import KeyIndex
from ..sources.scratch import Scratch
from ..streaming import stateful
from .common_sql import DUPES, HASHED, POLICY
from .operation_queries import CHILD_SQL, children
from .common_sql import CLAIMS, EV

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def nightly(rows, night, nights, scratch, run):
    """`rows` arrive night by night in one folder; `run` goes on with the stream each time.  The last run's result."""
    held = scratch.put(rows.withColumn("__night", night))
    path, shape, found = f"{scratch.root}/arrived", held.drop("__night").schema, None
    for n in range(nights):
        held.filter(F.col("__night") == n).drop("__night").write.mode("append").parquet(path)
        found = run(scratch.spark.readStream.schema(shape).parquet(path))
    return found


@query("q86_stream_leaders", """WITH RECURSIVE e AS (SELECT label AS block, vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
s(block, k, vec_id, leader, cos, held) AS (
  SELECT block, k, vec_id, vec_id, 1.0::DOUBLE, [{'i': vec_id, 'x': x}] FROM e WHERE k = 1
  UNION ALL SELECT block, k, vec_id, CASE WHEN best.c >= 0.4 THEN best.i ELSE vec_id END, CASE WHEN best.c >= 0.4 THEN best.c ELSE 1.0 END, CASE WHEN best.c >= 0.4 THEN held ELSE list_append(held, {'i': vec_id, 'x': x}) END
  FROM (SELECT e.block, e.k, e.vec_id, e.x, s.held, list_reduce(list_transform(list_filter(s.held, lambda h: h.i >= e.vec_id - 200), lambda h: {'c': list_cosine_similarity(h.x, e.x), 'i': h.i}), lambda p, q: CASE WHEN q.c > p.c THEN q ELSE p END, {'c': -2.0::DOUBLE, 'i': CAST(-1 AS BIGINT)}) AS best
    FROM e JOIN s ON e.block = s.block AND e.k = s.k + 1))
SELECT vec_id AS ord, leader, round(cos, 6) AS cos FROM s""")
def stream_leaders(spark, sf):
    """Vectors arrive an hour apart, up to forty hours late, over three nights; a leader serves for two hundred hours."""
    scratch = Scratch(spark, "stream_leaders")
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("block"), F.col("embedding").cast("array<double>").alias("embedding"))
    last = e.agg(F.max("ord")).first()[0] or 0
    time = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + n.cast("long") * 3600)
    rows = e.select(F.lpad(F.col("ord").cast("string"), 12, "0").alias("id"), F.col("block").cast("string").alias("block"), "embedding", time(F.col("ord")).alias("at"))
    tick = spark.range(1).select(F.lit(None).cast("string").alias("id"), F.lit("").alias("block"), F.lit(None).cast("array<double>").alias("embedding"), time(F.lit(last + 100)).alias("at"))
    hour = (F.unix_seconds("at") - 1_704_067_200) / 3600
    night = F.least(F.lit(2), F.floor((hour + F.pmod(F.xxhash64("at"), F.lit(40))) * 3 / F.lit(last + 1))).cast("int")
    found = nightly(rows.unionByName(tick), F.when(F.col("id").isNull(), 2).otherwise(night), 3, scratch, lambda s: stateful.run_stateful(stateful.leaders(s, "at", "block", 0.4, "48 hours", "200 hours"), scratch, "leaders"))
    return found.select(F.col("id").cast("long").alias("ord"), F.col("leader").cast("long").alias("leader"), F.round("cos", 6).alias("cos"))


@query("q87_stream_first_seen", f"WITH {HASHED} SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY (fetched_at - DATE '2024-01-01') // 10, ord) AS original FROM hashed")
def stream_first_seen(spark, sf):
    """Evidence arrives over four nights of ten days each; duplicates of any earlier night are found by the stored index."""
    scratch = Scratch(spark, "stream_first_seen")
    rows = v.hashed(v.evidence(spark, sf)).select("id", F.col("content_hash").alias("key"), "ord", "fetched_at")
    night = F.floor(F.datediff("fetched_at", F.lit("2024-01-01").cast("date")) / 10).cast("int")
    index = KeyIndex(spark, f"{scratch.root}/index")
    found = nightly(rows, night, 4, scratch, lambda s: stateful.first_seen_ever(s.drop("fetched_at"), index, scratch, "seen"))
    return found.select("id", "original")


@query("q88_stream_retention", f"""WITH {EV}, {CLAIMS}, {POLICY}, {CHILD_SQL}, gone AS (SELECT ev.id, source FROM ev JOIN pol USING (source) WHERE fetched_at < DATE '2024-07-25' - to_days(CAST(retention_days AS INT)))
SELECT source, count(*) AS deleted, CAST(sum(coalesce(sg.n, 0)) AS BIGINT) AS affected_segments, CAST(sum(coalesce(cn.n, 0)) AS BIGINT) AS affected_claims, 'retention' AS reason FROM gone LEFT JOIN sg ON gone.id = sg.evidence_id LEFT JOIN cn ON gone.id = cn.evidence_id GROUP BY source""")
def stream_retention(spark, sf):
    """The audit of q39, of rows that timers let go as the stream's own time passes."""
    scratch = Scratch(spark, "stream_retention")
    rows = v.evidence(spark, sf).select("id", "source", F.col("fetched_at").cast("timestamp").alias("at"))
    tick = spark.range(1).select(F.lit("").alias("id"), F.lit("").alias("source"), F.lit("2024-07-25").cast("timestamp").alias("at"))
    gone = nightly(rows.unionByName(tick), F.lit(0), 1, scratch, lambda s: stateful.run_stateful(stateful.expiring(s, "at", v.policies(spark), "0 seconds"), scratch, "gone"))
    counts, _ = lineage.delete(gone, children(spark, sf, None))
    return lineage.audit(gone, counts, "retention")


@query("q89_relinked_duplicates", f"""WITH RECURSIVE {DUPES}, {POLICY}, ln AS (SELECT dd.id, dd.ord, dd.is_duplicate_of AS up, dedupe_stage, fetched_at < DATE '2024-04-20' - to_days(CAST(retention_days AS INT)) OR ord % 5 = 0 AS gone FROM dd LEFT JOIN pol USING (source)),
w(id, over_id, root) AS (SELECT id, up, false FROM ln WHERE NOT coalesce(gone, false) AND up IS NOT NULL
  UNION ALL SELECT w.id, CASE WHEN t.up IS NULL THEN t.id ELSE t.up END, t.up IS NULL FROM w JOIN ln t ON t.id = w.over_id WHERE NOT w.root AND coalesce(t.gone, false)),
f AS (SELECT w.id, w.over_id, w.root FROM w JOIN ln t ON t.id = w.over_id WHERE w.root OR NOT coalesce(t.gone, false)),
h AS (SELECT f.*, first_value(f.id) OVER (PARTITION BY f.over_id ORDER BY ln.ord) AS heir FROM f JOIN ln ON ln.id = f.id WHERE f.root)
SELECT ln.id, CASE WHEN h.id IS NOT NULL THEN nullif(h.heir, h.id) ELSE f.over_id END AS is_duplicate_of, CASE WHEN h.heir = ln.id THEN NULL ELSE dedupe_stage END AS dedupe_stage
FROM ln LEFT JOIN f ON f.id = ln.id AND NOT f.root LEFT JOIN h ON h.id = ln.id WHERE NOT coalesce(ln.gone, false)""")
def relinked_duplicates(spark, sf):
    """Duplicates after a purge of what is past its retention, and of every fifth row by withdrawal."""
    from ..operators import dedupe

    held = v.Stored(spark, sf, "relinked", hashes=True, labels=False)
    rows = held.scratch.put(dedupe.duplicates(held.evidence).select("id", "ord", "source", "fetched_at", "is_duplicate_of", "dedupe_stage"))
    old = lineage.expired(rows, v.policies(spark), F.lit("2024-04-20").cast("date")).select("id")
    gone = held.scratch.put(old.unionByName(rows.filter("ord % 5 = 0").select("id")).distinct())
    return lineage.relinked(rows, gone, held.scratch.put).select("id", "is_duplicate_of", "dedupe_stage")
