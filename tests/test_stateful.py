"""Streams with state: leaders by event time whatever the batches, clusters that move, retention by timers, the key index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oremill.operators import lineage
from oremill.plans import stream_queries
from oremill.sources import views
from oremill.sources.keyindex import KeyIndex
from oremill.sources.scratch import Scratch
from oremill.streaming import stateful

from .compare import both, duck

SHAPE = "id string, block string, embedding array<double>, at timestamp"


def arrive(spark, scratch, rows):
    made = spark.createDataFrame([(i, b, e, t) for i, b, e, t in rows], "id string, block string, embedding array<double>, at long")
    made.withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{scratch.root}/in")
    return spark.readStream.schema(SHAPE).parquet(f"{scratch.root}/in")


def stream(spark, batches, threshold=0.9, late="1000 days", keep="10 hours", follow=False):
    """The links of all rows, told by batches, and the leaders that are left in state."""
    scratch, end = Scratch(spark, "t"), max(r[3] for b in batches for r in b) + 10**9
    for k, b in enumerate(batches):
        tick = [(None, "", None, end)] if k == len(batches) - 1 else []
        s = arrive(spark, scratch, b + tick)
        found = stateful.run_stateful(stateful.leaders(s, "at", "block", threshold, late, keep, follow), scratch, "out")
    held = spark.read.format("statestore").option("stateVarName", "leaders").load(f"{scratch.root}/out-checkpoint")
    return sorted((r.id, r.leader) for r in found.collect()), held.count(), scratch


def plain(rows, threshold=0.9, keep=36_000, follow=False):
    lead, out = [], []
    for i, b, e, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[3], r[0])):
        v = np.array(e or [], float)
        live = [x for x in lead if x[1] == b and x[3] >= t - keep and len(x[2]) == len(v)]
        cos = [float(x[2] @ v / (np.linalg.norm(x[2]) * np.linalg.norm(v))) for x in live] if np.linalg.norm(v) else []
        if cos and max(cos) >= threshold:
            best = live[cos.index(max(cos))]
            out.append((i, best[0]))
            if follow:
                best[2], best[3] = best[2] + v, t
        else:
            out.append((i, i))
            if np.linalg.norm(v):
                lead.append([i, b, v, t])
    return sorted(out)


@pytest.mark.parametrize("follow", [False, True])
def test_leaders_do_not_depend_on_batches(spark, follow):
    rng = random.Random(2)
    rows = [(f"r{k:03d}", rng.choice("xy"), [rng.random(), rng.random(), 0.1], 1_700_000_000 + 60 * rng.randrange(1500)) for k in range(60)]
    rows += [("odd1", "x", None, 1_700_000_100), ("odd2", "x", [], 1_700_000_100), ("odd3", "x", [0.0, 0.0, 0.0], 1_700_000_200), ("odd4", "y", [1.0], 1_700_000_300), ("odd5", None, [1.0], 1_700_000_300)]
    want = plain([(i, b or "", e, t) for i, b, e, t in rows], follow=follow)
    rng.shuffle(rows)
    for batches in ([rows], [rows[:20], rows[20:50], rows[50:]]):
        got, held, _ = stream(spark, batches, follow=follow)
        assert got == want and held == 0  # the watermark has passed all of them


def test_old_leaders_leave_a_live_block(spark):
    """Rows of one block an hour apart, each unlike the rest: the state holds the leaders of the last ten hours and those that wait."""
    rows = [(f"r{k:02d}", "x", [1.0 if j == k else 0.0 for j in range(40)], 1_700_000_000 + 3600 * k) for k in range(40)]
    scratch = Scratch(spark, "t")
    for part in (rows[:20], rows[20:]):
        s = arrive(spark, scratch, part)
        stateful.run_stateful(stateful.leaders(s, "at", "block", 0.9, "2 hours", "10 hours"), scratch, "out")
    held = spark.read.format("statestore").option("stateVarName", "leaders").load(f"{scratch.root}/out-checkpoint")
    assert 10 <= held.count() <= 12
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{scratch.root}/out-checkpoint")
    assert waiting.count() == 2  # what is newer than the watermark


def test_leaders_with_large_numbers(spark, tmp_path):
    """Hours counted from the newest vec_id go beyond 32 bits of seconds."""
    duck("/root/testdata/sf0.001").sql("SELECT * REPLACE (vec_id + 900000 AS vec_id) FROM embeddings ORDER BY vec_id LIMIT 60").write_parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, stream_queries.QUERIES["q86_stream_leaders"], stream_queries.ORACLES["q86_stream_leaders"], tmp_path)
    assert got == want and len(got[1]) == 60


def test_retention_by_timers(spark):
    """Rows come out on the day they are due, not before, and none of a source without a limit."""
    scratch, path = Scratch(spark, "t"), None
    policy = views.policies(spark).withColumn("retention_days", F.when(F.col("source") == "reddit", 10))

    def night(rows):
        spark.createDataFrame(rows, "id string, source string, at string").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{scratch.root}/in")
        s = spark.readStream.schema("id string, source string, at timestamp").parquet(f"{scratch.root}/in")
        return {(r.id, str(r.due)) for r in stateful.run_stateful(stateful.expiring(s, "at", policy, "0 seconds"), scratch, "out").collect()}

    assert night([("a", "reddit", "2024-01-01 10:00:00"), ("b", "searxng", "2024-01-01 10:00:00"), ("c", "nobody", "2024-01-01 00:00:00"), ("d", "reddit", "2024-01-05 00:00:00")]) == set()
    assert night([("", "", "2024-01-11 23:00:00")]) == set()
    assert night([("", "", "2024-01-12 00:00:01")]) == {("a", "2024-01-12 00:00:00")}
    assert night([("e", "reddit", "2024-03-01 00:00:00")]) == {("a", "2024-01-12 00:00:00"), ("d", "2024-01-15 00:00:00")}


# ---------------------------------------------------------------- keys
def index_run(spark, index, run, rows):
    made = spark.createDataFrame(rows, "id string, key string, ord long")
    return {(r.id, r.original) for r in index.first_seen(made, run, Scratch(spark, "t")).collect()}


def test_first_seen_over_runs(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"))
    assert index_run(spark, index, "r1", [("a", "k1", 2), ("b", "k1", 1), ("c", "", 1), ("d", None, 1), ("e", "k2", 5)]) == {("a", "b"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", "e")}
    second = [("f", "k2", 1), ("g", "k3", 1), ("h", "k3", 2)]
    want = {("f", "e"), ("g", "g"), ("h", "g")}
    assert index_run(spark, index, "r2", second) == want and index_run(spark, index, "r2", second) == want  # a run that is repeated
    assert index_run(spark, index, "r3", [("z", "k3", 1), ("y", "k1", 1)]) == {("z", "g"), ("y", "b")}
    assert index_run(spark, index, "r4", []) == set() and index.runs() == ["r1", "r2", "r3", "r4"]


def test_files_without_a_hit_are_not_read(spark, tmp_path, monkeypatch):
    from oremill.sources import keyindex

    monkeypatch.setattr(keyindex, "FILE_KEYS", 100)
    monkeypatch.setattr(keyindex, "WANTED", 50)
    index = KeyIndex(spark, str(tmp_path / "i"))
    for run in range(3):
        index.add(f"r{run}", spark.range(run * 1000, run * 1000 + 1000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("id"), "id").alias("id")))
    wanted = spark.createDataFrame([("k1500",), ("k7",), ("nowhere",)], "key string")
    files = index.files(index.candidates(wanted, index.runs()))
    assert 2 <= len(files) <= 4  # of thirty
    for folder in (tmp_path / "i" / "keys").glob("run=*/bucket=*"):
        if str(folder) not in files:  # no look-up may open these
            for f in folder.glob("part-*"):
                f.write_bytes(b"spoilt")
    assert {(r.key, r.first_id) for r in index.look_up(wanted, Scratch(spark, "t")).collect()} == {("k1500", "id1500"), ("k7", "id7")}


def test_filters_rule_out_most_strangers(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"))
    index.add("r", spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("id")))
    held = index.candidates(spark.range(20_000).select(F.col("id").cast("string").alias("key")), ["r"]).count()
    strangers = index.candidates(spark.range(10**6, 10**6 + 20_000).select(F.col("id").cast("string").alias("key")), ["r"]).count()
    assert held == 20_000 and strangers < 0.02 * 20_000


def test_a_segment_without_filters_does_not_count(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"))
    index_run(spark, index, "r1", [("a", "k", 1)])
    (tmp_path / "i" / "filters" / "r1" / "_SUCCESS").unlink()
    assert index.runs() == [] and index_run(spark, index, "r2", [("b", "k", 1)]) == {("b", "b")}


# ---------------------------------------------------------------- links
def relink(spark, rows, gone):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(i, o, up, "exact" if up else None) for i, o, up in rows], "id string, ord long, is_duplicate_of string, dedupe_stage string")
    got = lineage.relinked(df, spark.createDataFrame([(g,) for g in gone], "id string"), scratch.put)
    return {r.id: r.is_duplicate_of for r in got.collect()}


def test_relinked_chains(spark):
    chain = [("a", 1, None), *[(chr(98 + k), k + 2, chr(97 + k)) for k in range(9)]]  # a <- b <- ... <- j
    assert relink(spark, chain, ["c", "d", "e", "f", "g"]) == {"a": None, "b": "a", "h": "b", "i": "h", "j": "i"}
    assert relink(spark, chain, ["a", "b", "c", "d"]) == {"e": None, "f": "e", "g": "f", "h": "g", "i": "h", "j": "i"}
    assert relink(spark, chain, [c for c, _, _ in chain]) == {} and relink(spark, chain, []) == {i: up for i, _, up in chain}
    fan = [("a", 1, None), ("b", 4, "a"), ("c", 3, "a"), ("d", 3, "a"), ("e", 9, "b"), ("x", 1, None), ("y", 2, "x")]
    assert relink(spark, fan, ["a"]) == {"c": None, "b": "c", "d": "c", "e": "b", "x": None, "y": "x"}
    assert relink(spark, fan, ["a", "b"]) == {"c": None, "d": "c", "e": "c", "x": None, "y": "x"}
    assert relink(spark, [], ["a"]) == {}
    with pytest.raises(ValueError):
        relink(spark, [("a", 1, "b"), ("b", 2, "a"), ("c", 3, "a")], ["a", "b"])


def test_retention_counts_the_time_of_day(spark):
    rows = spark.createDataFrame([("a", "reddit", "2024-01-01 10:00:00"), ("b", "reddit", "2024-01-01 20:00:00")], "id string, source string, at string")
    rows = rows.withColumn("fetched_at", F.col("at").cast("timestamp"))
    policy = views.policies(spark).withColumn("retention_days", F.lit(10))
    assert [r.id for r in lineage.expired(rows, policy, F.lit("2024-01-11 15:00:00").cast("timestamp")).collect()] == ["a"]
