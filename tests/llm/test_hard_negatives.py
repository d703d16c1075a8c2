"""Hard negatives against a sort of all pairs.  The query has a SQL oracle besides."""

import math
import random

import pytest
from pyspark.sql import functions as F

from oremill.llm import hard_negatives as x
from oremill.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int, uid string"


def brute(rows, k=5, low=80):
    held = []
    for n, (i, e, label) in enumerate(rows):
        if label is not None and e is not None and all(c is not None and math.isfinite(c) for c in e):
            held.append((i, label, [math.floor(256 * c) for c in e], n))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, label, v, n in held:
        if i is None or i % 100:
            continue
        dot = [(sum(p * q for p, q in zip(v, w)), j, m == label) for j, m, w, o in held if o != n and len(w) == len(v)]
        for s, j, _ in sorted((d for d in dot if d[2]), key=order)[:5]:
            negatives = sorted((d for d in dot if not d[2] and low * s <= 100 * d[0] <= 100 * s), key=order)[:k]
            out += [(i, j, rank, m, s, t) for rank, (t, m, _) in enumerate(negatives, 1)]
    return sorted(map(str, out))


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "s", 1, "u") for r in rows], SCHEMA)
    made = x.hard_negatives(x.integer_vectors(df), F.col("vec_id") % 100 == 0, Scratch(spark, "t"), **kw)
    got = sorted(str(tuple(r)) for r in made.collect())
    assert got == brute(rows, **{k: v for k, v in kw.items() if k in ("k", "low")})
    return got


def near(rng, dim=6):
    return [float(round(0.5 + rng.random() / 3, 2)) for _ in range(dim)]


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 17)])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(x, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(x, "ROW_BLOCK", blocks[1])
    rng = random.Random(5)
    rows = [(i * 10, near(rng), rng.randrange(3)) for i in range(120)]
    assert len(check(spark, rows)) > 100
    check(spark, rows, k=2, low=95)


def test_hot_label_and_ties(spark, monkeypatch):
    """One vector and one label hold most rows; every score ties."""
    monkeypatch.setattr(x, "ROW_BLOCK", 32)
    rows = [(i, [0.5, 0.25], 1 if i % 3 else 2) for i in range(300)]
    assert len(check(spark, rows)) == 3 * 5 * 5


def test_odd_rows(spark):
    ok = [0.9, 0.8]
    rows = [
        (0, ok, 1), (100, ok, 1), (100, ok, 1), (1, ok, 2), (1, ok, 2), (None, ok, 2), (None, ok, 1), (2, None, 1), (3, [0.9, None], 2), (4, [float("nan"), 1.0], 2),
        (5, [float("inf"), 1.0], 2), (6, ok, None), (7, [0.9], 2), (200, [0.9], 1), (300, [], 1), (8, [], 2), (9, [], 1), (-100, [-0.9, -0.8], 1), (-1, [0.0, 0.0], 1),
    ]
    assert check(spark, rows)
    assert check(spark, []) == [] and check(spark, [(0, ok, 1)]) == [] and check(spark, [(7, None, None)]) == []


def test_large_components(spark):
    check(spark, [(0, [3e6, 1e7], 1), (1, [3e6, 1e7], 1), (2, [2.9e6, 1e7], 2), (3, [1e7, 2e6], 2)])
