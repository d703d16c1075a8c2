"""Exact de-duplication against brute force, and its code."""

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from oremill.llm import exact_dedup as x
from oremill.llm.common import Scratch


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, sha string, slice int")
    got = x.exact_dedup(df, Scratch(spark, "t")).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    best = {t: max(g, key=lambda d: (d is not None, d or 0)) for t, g in groups.items()}
    want = sorted((str(d), str(best[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(k for k, _ in kept) == sorted({w[3] for w in want}) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(x, "SLICE_BYTES", 64)
    rows = [(1, None), (2, ""), (3, "Abc É"), (4, "aBC É"), (5, "abc é"), (6, "abc É"), (6, "abc É"), (6, "other"), (None, "other"), (None, "alone"), (None, None), (9, "z" * 100_000), (10, "Z" * 100_000), (-4, " abc É")]
    check(spark, rows)
    check(spark, [(i, "copy") for i in range(300)] + [(1000 + i, f"t{i % 50}") for i in range(200)])


def test_empty(spark):
    assert x.exact_dedup(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).collect() == []


def test_rice_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 100, 5000):
        for top in (1, 50, 1 << 20, (1 << 63) + 5):
            v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            k, code = x.rice_encode(v)
            assert (x.rice_decode(n, k, code) == v).all()


def test_equal_digests_of_different_texts(spark, monkeypatch):
    """With a digest of one value, bytes alone tell groups apart."""
    df = spark.createDataFrame([(i, f"t{i % 5}".encode(), 0, "same", 0, i) for i in range(40)], "doc_id long, norm binary, print long, sha string, slice long, pos long")
    got = x.verified(df, Scratch(spark, "t")).collect()
    assert sorted((bytes(r.other).decode(), r.keep_id, r.group_size) for r in got) == [(f"t{k}", 35 + k, 8) for k in range(5)]


def test_an_owner_holds_a_fingerprint_once_a_slice(spark):
    """A million equal texts are one coded value and one repeat bit in each slice that has them."""
    import pyarrow as pa

    sha = hashlib.sha256(b"copy").digest()
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([sha * 1_000_000], pa.binary())], names=["slice", "shas"])
    (sent,) = x._send(4)(iter([batch]))
    assert sent.column("n").to_pylist() == [1] and len(sent.column("code")[0].as_py()) < 32
    (bits,) = x._answer(pa.Table.from_batches([sent]))["bitmap"].to_pylist()
    assert bits == b"\x80"


def test_ids_at_the_end_of_the_range(spark):
    check(spark, [(-(1 << 63), "a"), (None, "a"), (None, "b"), (None, "b"), (-(1 << 63), "c")])
