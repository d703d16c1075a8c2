"""The payload source and what collect stores of it; deletions by command; values in force at a time; stored partials."""

import json
import random

import pytest
from pyspark.sql import functions as F

from oremill import cli
from oremill.operators import asof, partials, reports
from oremill.sources import payload_source, payloads, views
from oremill.sources.scratch import Scratch
from oremill.sources.store import Store


def line(query, n=1, error=None, tag=""):
    return json.dumps({"query": query, "results": [{"url": f"https://{query}{tag}{i}.test/a", "title": f"Title {tag}{i}", "content": f"text {query}{tag}{i}", "engines": ["e"], "score": i} for i in range(n)], "error": error}) + "\n"


def folder(tmp_path, held):
    for source, lines in held.items():
        (tmp_path / "p" / f"source={source}").mkdir(parents=True)
        (tmp_path / "p" / f"source={source}" / "part-0.json").write_text("".join(lines))
    return str(tmp_path / "p")


def allowing(spark, *sources):
    p = views.policies(spark).filter(F.col("source") == "searxng").drop("source")
    return p.join(spark.createDataFrame([(s,) for s in sources], "source string")).select("source", *p.columns)


def test_ranges_cover_every_line_once(spark, tmp_path):
    rng = random.Random(4)
    lines = [line(f"q{i}", rng.randrange(3), tag="é" * rng.randrange(9)) for i in range(15)]
    path = folder(tmp_path, {"searxng": lines, "reddit": lines})
    for split in (61, 10**6):
        rows = payload_source.read_gated(spark, path, views.policies(spark), split)
        assert sorted(r.query for r in rows.collect()) == sorted(f"q{i}" for i in range(15))
        assert {r.source for r in rows.collect()} == {"searxng"}
    assert rows.rdd.getNumPartitions() == 1 and payload_source.read_gated(spark, path, views.policies(spark), 500).rdd.getNumPartitions() >= 3
    part = payload_source.PayloadReader({"path": path, "allowed": '["searxng"]', "split_bytes": "1"})
    assert sum(len(list(part.lines(r))) for r in part.partitions()) == 15  # every byte a range of its own


def test_denied_sources_are_not_opened(spark, tmp_path):
    path = folder(tmp_path, {"searxng": [line("a"), "{broken\n", "[1]\n", "\n", json.dumps({"query": 5, "results": None}) + "\n"], "reddit": ["x"]})
    (tmp_path / "p" / "source=reddit" / "part-0.json").chmod(0)
    rows = payload_source.read_gated(spark, path, views.policies(spark)).collect()
    assert sorted((str(r.query), len(r.results), str(r.error)) for r in rows) == [("5", 0, "None"), ("None", 0, "payload is not readable"), ("None", 0, "payload is not readable"), ("a", 1, "None")]
    spark.dataSource.register(payload_source.PayloadSource)
    assert spark.read.format("search_payloads").load(path).count() == 0  # no rights, no rows


def test_conditions_choose_folders_and_lines(spark, tmp_path):
    path = folder(tmp_path, {"a": [line("x"), line("y")], "b": [line("x")], "c": [line("z")]})
    rows = payload_source.read_gated(spark, path, allowing(spark, "a", "b", "c"))
    assert rows.filter("source = 'a'").rdd.getNumPartitions() == 1 and rows.rdd.getNumPartitions() == 3
    assert sorted((r.source, r.query) for r in rows.filter("source IN ('a', 'b') AND query = 'x'").collect()) == [("a", "x"), ("b", "x")]
    assert rows.filter("source = 'd'").count() == 0 and rows.filter("query LIKE 'z%'").count() == 1
    reader = payload_source.PayloadReader({"path": path, "allowed": '["a", "b"]'})
    kept = [payload_source.EqualTo(("error",), "e")]
    assert list(reader.pushFilters([payload_source.EqualTo(("source",), "a"), payload_source.In(("query",), ("x", "y")), *kept])) == kept
    assert reader.allowed == {"a"} and reader.queries == {"x", "y"} and [p.source for p in reader.partitions()] == ["a"]


def test_collected(spark, tmp_path):
    path = folder(tmp_path, {"a": [line("q", 2), line("q", 2), line("q", 1, "timed out"), line("other")], "b": [line("q", 0)], "reddit": [line("q", 3)]})
    policy = allowing(spark, "a", "b", "nofolder").unionByName(views.policies(spark).filter("source = 'reddit'"))
    requests = spark.createDataFrame([("q", f"id_{v}", v, s) for v in ("v1", "v2") for s in ("a", "b", "reddit", "nofolder", "stranger")], "query string, query_id string, vertical string, source string")
    raw = payload_source.read_gated(spark, path, policy)
    runs, rows = payloads.collected(raw, requests, payload_source.folders(spark, path), policy, 10, F.lit("2024-05-01").cast("timestamp"))
    got = sorted((r.source, r.vertical, r.status, str(r.reason), r.record_count) for r in runs.collect())
    assert [g for g in got if g[1] == "v1"] == [
        ("a", "v1", "error", "timed out", 0), ("a", "v1", "ok", "None", 2), ("b", "v1", "empty", "None", 0), ("nofolder", "v1", "error", "no adapter registered", 0),
        ("reddit", "v1", "disabled", "disabled", 0), ("stranger", "v1", "disabled", "unknown source", 0),
    ]
    found = rows.collect()
    names = {r.source_run_id: r for r in runs.collect()}
    assert len(found) == 4 and {(r.vertical, r.query_id) for r in found} == {("v1", "id_v1"), ("v2", "id_v2")}
    assert all(names[r.source_run_id].status == "ok" and names[r.source_run_id].query_id == r.query_id for r in found)


# ---------------------------------------------------------------- commands
def test_collect_and_delete_by_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "v.yaml").write_text("verticals:\n  ops: {name: Operations, queries: [imports, exports], sources: [searxng, reddit, newsfeed]}\n")
    (tmp_path / "pol.yaml").write_text(
        "version: 7\nsources:\n  searxng: {enabled: true, retention_days: 10, rights: {collect_enabled: true, store_derived: true, aggregate: true, local_inference: true}}\n"
        "  reddit: {enabled: false, retention_days: 90, rights: {store_derived: true}}\n  newsfeed: {enabled: true, rights: {collect_enabled: true, store_derived: true}}\n"
    )
    same = {"url": "https://same.test/a", "title": "Why does it not export?", "content": "the same text, every week by hand"}
    lines = [json.dumps({"query": q, "results": [same, {"url": f"https://{q}.test/", "title": q, "content": f"about {q}"}]}) + "\n" for q in ("imports", "exports")]
    path = folder(tmp_path, {"searxng": lines, "reddit": [line("imports", 3)]})

    def go(*argv, now="2024-05-01 10:00:00"):
        cli.main(["--root", str(tmp_path / "t"), "--verticals", str(tmp_path / "v.yaml"), "--policies", str(tmp_path / "pol.yaml"), *(["--now", now] if now else []), *argv], spark)
        return capsys.readouterr().out

    go("doctor")
    out = go("collect", "--payloads", path, "--vertical", "ops")
    assert "reddit\t2\t0\tdisabled" in out and "newsfeed\t2\t0\terror\tno adapter registered" in out
    held = Store(spark, str(tmp_path / "t"))
    rows = held.scan("evidence_event").collect()
    assert len(rows) == 4 and {r.source for r in rows} == {"searxng"} and {r.policy_version for r in rows} == {7}
    runs = {r.id: r.query_id for r in held.scan("source_run", status="ok").collect()}
    assert all(runs[r.source_run_id] == r.query_id for r in rows) and len({r.query_id for r in rows}) == 2
    assert json.loads(go("pipeline", "--all"))["failed"] == {}
    links = {r.id: r.is_duplicate_of for r in held.scan("evidence_event").collect()}
    copy, original = next((k, x) for k, x in links.items() if x)
    assert held.scan("problem_hypothesis").count() and original in links
    # the original is withdrawn upstream: its copy becomes an original, whatever else hangs on it goes
    (tmp_path / "n.csv").write_text("source,canonical_url\nsearxng,https://nothing.test/\n")
    assert go("deletions", "--notices", str(tmp_path / "n.csv")).count("\n") == 1
    held.replace("evidence_event", Scratch(spark, "t").put(held.scan("evidence_event").withColumn("canonical_url", F.when(F.col("id") == original, "https://gone.test/").otherwise(F.col("canonical_url")))))
    (tmp_path / "n.csv").write_text("source,canonical_url\nsearxng,https://gone.test/\n")
    assert "searxng\t1" in go("deletions", "--notices", str(tmp_path / "n.csv"), now=None)
    left = {r.id: r.is_duplicate_of for r in held.scan("evidence_event").collect()}
    assert original not in left and left[copy] is None and len(left) == 3
    # without --now, both tables of the audit carry the same id
    assert [r.deletion_id for r in held.scan("deleted_evidence").collect()] == [r.id for r in held.scan("deletion_event").collect()]
    assert go("deletions", now="2024-05-11 09:59:59").count("\n") == 1 and "searxng\t3" in go("deletions", now="2024-05-11 10:00:01")


# ---------------------------------------------------------------- as of
def by_hand(left, right):
    out = []
    for k, t, n in left:
        held = [(s, v) for j, s, v in right if j == k and k is not None and s is not None and t is not None and s <= t]
        out.append((n, max(held)[1] if held else None))
    return sorted(out, key=str)


def as_of(spark, left, right, **kw):
    ldf = spark.createDataFrame(left, "k string, t timestamp, n int")
    rdf = spark.createDataFrame(right, "k string, s timestamp, v int")
    return sorted(((r.n, r.v) for r in asof.as_of(ldf, rdf, ["k"], "t", "s", ["v"], Scratch(spark, "t").put, **kw).collect()), key=str)


def moments(spark, rows):
    from datetime import datetime, timedelta

    return [(k, None if t is None else datetime(2024, 1, 1) + timedelta(seconds=t), n) for k, t, n in rows]


@pytest.mark.parametrize("cell", [1 << 18, 3, 1])
def test_as_of(spark, monkeypatch, cell):
    """A hot key, many rows of one moment, changes before, at and after, in cells of any width."""
    monkeypatch.setattr(asof, "CELL_ROWS", cell)
    rng = random.Random(cell)
    left = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, 500, *range(-40, 1000, 7)]), i) for i in range(120)]
    right = [(rng.choice(["hot", "b", "c", None]), rng.choice([None, *range(0, 1000, 13)]), i) for i in range(60)]
    assert as_of(spark, moments(spark, left), moments(spark, right)) == by_hand(left, right)


def test_as_of_edges(spark):
    assert as_of(spark, [], moments(spark, [("a", 1, 1)])) == [] and as_of(spark, moments(spark, [("a", 1, 1)]), []) == [(1, None)]
    left, right = moments(spark, [("a", 86_400 * 3, 1), ("a", 86_400 * 2, 2)]), moments(spark, [("a", 0, 7)])
    assert as_of(spark, left, right, within="2") == [(1, None), (2, 7)]
    with pytest.raises(ValueError):
        asof.as_of(spark.createDataFrame(left, "k string, t timestamp, v int"), spark.createDataFrame(right, "k string, s timestamp, v int"), ["k"], "t", "s", ["v"], None)


# ---------------------------------------------------------------- partials
def test_partials_are_replaced_by_day(spark, tmp_path):
    store = partials.Partials(spark, str(tmp_path / "p"))
    rows = spark.range(30_000).select(F.expr("date_add(date'2024-01-01', cast(id % 3 as int))").alias("day"), F.lit("k").alias("key"), (F.col("id") % 7000).alias("user"), (F.col("id") / 3).alias("x"))
    make = lambda df: partials.daily(df, F.col("day"), ["key"], {"s": F.col("x")}, distinct=F.col("user"), measure=F.col("x"))
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        store.put(make(rows.filter(F.col("day") == F.lit(day).cast("date"))))
    stamp = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "p" / "day=2024-01-01").iterdir()}
    store.put(make(rows.filter("day = date'2024-01-03'").unionByName(rows.filter("day = date'2024-01-03'").limit(5))))  # five late rows
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "p" / "day=2024-01-01").iterdir()} == stamp
    got = partials.merged(store.read(), ["key"]).select("n", partials.n_distinct().alias("users"), partials.quantile(0.9).alias("q")).first()
    assert got.n == 30_005 and abs(got.users - 7000) <= partials.DISTINCT_ERROR * 7000 and abs(got.q - 9000) <= partials.RANK_ERROR * 10_000
    assert partials.merged(store.read(), ["key"], by_day=True).count() == 3
    want = reports.velocity(rows, "key", F.col("day")).first()
    assert want.recent == 10_000 and reports.velocity_of(store.read().select("key", "day", F.least("n", F.lit(10_000)).alias("n")), "key").first() == want
    assert partials.daily(rows.limit(0), F.col("day"), ["key"]).count() == 0
