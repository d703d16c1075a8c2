"""Toxicity: held-out accuracy, located sentences and edge cases."""

import zlib

from oremill.llm import toxicity
from oremill.llm.common import Scratch

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.query(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert held and all(got[d].held_out for d in held)
    assert sum(got[d].predicted == labels[d] for d in held) / len(held) >= 0.97
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_sentences_are_located_and_edges_hold(spark):
    clean = [f"The road is long number {i}. Nice day at hill {i % 7}!" for i in range(60)]
    bad = [f"The road is long number {i}. You zonker fool {i % 7}!" for i in range(40)]
    docs = [(i, t, "x") for i, t in enumerate(clean + bad)] + [(200, None, "x"), (201, "", "x"), (None, "zonker here.", "x"), (202, "fine. " * 5000 + "é zonker! fine.", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, Scratch(spark, "t"))
    rows = toxicity.score(df, model).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[200].score == by[201].score == 0
    assert by[3].score < 0.5 < by[70].score
    span = by[202].offending
    raw = by[202].text.encode()
    assert [raw[s.start : s.end].decode() for s in span] == ["é zonker"]
    assert [r.score > 0.5 for r in rows if r.doc_id is None] == [True]
    none = toxicity.fit(df, labels.filter("toxic = 0"), Scratch(spark, "t"))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).collect() == []
