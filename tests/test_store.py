"""Versions of tables: failed writes, writers at the same time, and what vacuum leaves; rubric floors, modes and repeated edits."""

import pytest
from pyspark.sql import functions as F

from oremill.errors import WriteConflict
from oremill.operators import experiments, ideas, review
from oremill.plans import run
from oremill.settings import Rubric
from oremill.sources import store


def queries(spark, *names):
    return spark.createDataFrame([(n, n, "ops") for n in names], "id string, text string, vertical string")


def held_ids(s):
    return sorted(r.id for r in s.scan("query").collect())


@pytest.fixture
def tables(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "t"))


def test_what_a_failed_write_left_is_not_read(spark, tables, monkeypatch):
    tables.replace("query", queries(spark, "a"))
    with monkeypatch.context() as m:  # the rows are written, the list is not
        m.setattr(store.Store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            tables.replace("query", queries(spark, "stray"))
        with pytest.raises(OSError):
            tables.append("query", queries(spark, "stray"))
    half = queries(spark, "b").withColumn("text", F.when(F.col("id") == "b", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        tables.append("query", half)
    assert held_ids(tables) == ["a"]
    tables.replace("query", queries(spark, "new"))
    tables.append("query", queries(spark, "more"))
    assert held_ids(tables) == ["more", "new"] and len(tables.versions("query")) == 3
    tables.vacuum()
    assert held_ids(tables) == ["more", "new"] and len(tables.versions("query")) == 1
    folders = [f.getPath().getName() for f in tables._fs.listStatus(tables._path(f"{tables.root}/query"))]
    assert len(folders) == 3  # the list and two folders of rows


def test_two_writers(spark, tables, monkeypatch):
    other = store.Store(spark, tables.root)
    tables.replace("query", queries(spark, "a"))
    write, done = store.Store._write, []

    def slow(self, name, rows):
        path = write(self, name, rows)
        if self is tables and not done:
            done.append(1)
            other.append("query", queries(spark, "b"))
        return path

    monkeypatch.setattr(store.Store, "_write", slow)
    with pytest.raises(WriteConflict):
        tables.replace("query", queries(spark, "c"))
    assert held_ids(tables) == ["a", "b"]
    done.clear()
    tables.append("query", queries(spark, "d"))
    assert held_ids(tables) == ["a", "b", "b", "d"]


def test_an_old_version_stays_readable(spark, tables):
    tables.replace("query", queries(spark, "a"))
    before = tables.scan("query")
    tables.replace("query", before.filter("id = 'z'"))
    assert held_ids(tables) == [] and before.count() == 1


def test_floors_of_a_rubric_change_the_bands(spark):
    feats = {f: F.lit(1.0) for f in ideas.FEATURES} | {"comparison_present": F.lit(True), "budget_roi_present": F.lit(True)}
    parts = {"buyer": "b", "channel": "c", "smallest_paid_test": "t", "compliance_status": "policy_ok_local_research", "form": "f"}
    row = spark.range(1).withColumns(feats | {k: F.lit(x) for k, x in parts.items()})
    total = ideas.scored(row, reviewed=F.lit(True)).first()
    for floors, want in (((("paid_validation", 1.0),), "paid_validation"), ((("paid_validation", 99.9), ("collect_more", total.total)), "collect_more"), ((("interview", 99.9),), "archive")):
        assert ideas.scored(row, reviewed=F.lit(True), bands=Rubric(bands=floors).bands).first().band == want


def test_each_vertical_falls_back_by_itself(spark):
    rows = spark.createDataFrame(
        [(i, f"e{i}", v, "How do I stop this?", "it takes forever", ["problem_aware"]) for i, v in enumerate(["a", "a", "b", "c"])],
        "ord long, id string, vertical string, title string, snippet string, intent_labels array<string>",
    )
    said = spark.createDataFrame([("e1", 0, "m-1"), ("e3", 0, "m-1"), ("nobody", 0, "m-1")], "evidence_id string, ord long, model_version string")
    got = {(r.evidence_id, r.model_version) for r in ideas.extracted(said, rows, "vertical").collect()}
    assert got == {("e1", "m-1"), ("e2", ideas.HEURISTIC), ("e3", "m-1")}
    unknown = said.filter("evidence_id = 'nobody'")
    assert {r.model_version for r in ideas.extracted(unknown, rows, "vertical").collect()} == {ideas.HEURISTIC}
    empty = rows.select("vertical").limit(0)
    frames = {"marked": rows.withColumn("is_duplicate_of", F.lit(None).cast("string")), "originals": rows, "claims": ideas.extracted(said, rows, "vertical"), "clusters": empty, "hypotheses": empty, "ideas": empty}
    assert {r.vertical: r.extraction_mode for r in run.counters(frames).collect()} == {"a": "llm", "b": "heuristic", "c": "llm"}


def test_of_repeated_requests_the_last_counts(spark):
    hyps = spark.createDataFrame([("h", "old", "j"), ("k", "old", "j")], "id string, buyer string, job string")
    edits = spark.createDataFrame([("h", "one", "x"), ("h", None, "y"), ("h", "two", None)], "id string, buyer string, job string")
    got = sorted(map(tuple, review.edited(hyps, edits).select("id", "buyer", "job", "reviewed").collect()))
    assert got == [("h", "two", "y", True), ("k", "old", "j", False)]
    drafts = spark.createDataFrame([("x", "draft", 20.0, "p", 0.8, 3, 48.0, 48.0)], "id string, status string, price double, provenance string, margin double, months int, cap double, spend double")
    asked = spark.createDataFrame([("x", 10.0), ("x", 30.0)], "id string, price double")
    rows = experiments.started(drafts, asked, F.lit("2024-01-01").cast("date")).collect()
    assert [r.price for r in rows] == [30.0]
