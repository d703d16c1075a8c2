"""Fingerprints against a plain version, exact generalised Jaccard similarities, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oremill.llm import fingerprints as x
from oremill.llm.common import Scratch

SCHEMA = "doc_id long, text string, fingerprint string, n_chars int, part string"


def bag(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text))
    return Counter(tuple(words[max(0, i - 4) : i + 1]) for i in range(len(words)))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def plain_samples(hashes, weights):
    """The identities one term at a time, in double precision, by the formulas as they are published."""
    r_of, ln_c_of = x._quantiles()
    out = []
    for seed in x._seeds(x.SAMPLES).tolist():
        best = None
        for h, w in zip(hashes.tolist(), weights.tolist()):
            v = (h ^ seed) * 0xD6E8FEB86659FD93 % 2**64
            v = (v ^ (v >> 32)) * 0xD6E8FEB86659FD93 % 2**64
            r, ln_c, b = float(r_of[v >> 32 & 0xFFFF]), float(ln_c_of[v >> 48]), (v & 0xFFFFFFFF) / 2**32
            t = math.floor(math.log(w) / r + b)
            y = math.exp(r * (t - b))
            a = math.exp(ln_c) / (y * math.exp(r))
            best = min(best, (a, h, t)) if best else (a, h, t)
        name = x.mix(np.array([best[1] ^ (best[2] * 0xC2B2AE3D27D4EB4F % 2**64) ^ seed], np.uint64))[0] >> np.uint64(48)
        out.append(max(1, int(name)))
    return out


def test_plain_version(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (1, 2, 7, 40, 300)] + ["", "same " * 500, "X y\tZ"]
    whole = x.signatures(pa.array(texts))
    h, w, bounds = x.terms(pa.array(texts))
    assert w.max() > 400 and [sum(bag(t).values()) for t in texts] == [int(w[a:b].sum()) for a, b in zip(bounds, bounds[1:])]
    for k, t in enumerate(texts):
        want = plain_samples(h[bounds[k] : bounds[k + 1]], w[bounds[k] : bounds[k + 1]]) if t else [0] * x.SAMPLES
        assert np.mean(whole[k] == want) >= 1 - 1 / x.SAMPLES  # single precision may turn a near tie
    monkeypatch.setattr(x, "SLICE", 7)  # rows that span slices
    assert (x.signatures(pa.array(texts)) == whole).all()


def test_collision_rate_is_the_generalised_jaccard():
    """Over many samples the share of equal ones comes within four standard deviations, for weights of 1 and above."""
    rng, n = random.Random(1), 4096
    for words, size in ((400, 60), (4, 60), (2, 25)):
        for _ in range(4):
            a = [f"w{rng.randrange(words)}" for _ in range(size)]
            cut = rng.randrange(size)
            b = a[:cut] + [f"w{rng.randrange(words)}" for _ in range(rng.randrange(1, size))]
            both = x.signatures(pa.array([" ".join(a), " ".join(b)]), count=n)
            want = jaccard(" ".join(a), " ".join(b))
            assert abs((both[0] == both[1]).mean() - want) <= 4 * math.sqrt(max(want * (1 - want), 1e-3) / n)
    x._seeds.cache_clear()


def test_gamma_quantiles():
    r, ln_c = x._quantiles()
    assert abs(r.mean() - 2) < 1e-3 and abs(r.var() - 2) < 5e-3 and abs(ln_c.mean() - (1 - 0.5772156649)) < 1e-3 and (np.diff(r) > 0).all()


def check(spark, rows, parts=None):
    df = spark.createDataFrame([(*r, "f", 1, "p") for r in rows], SCHEMA)
    got = x.beside_next(df.repartition(parts) if parts else df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text")).collect()}
    order = sorted(((d, t) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    texts = [t or "" for _, t in order]
    want = []
    for k, (d, _) in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, n = x.signatures(pa.array([t, edited, after]))
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), *x.hexed(np.array([a, e])), float((a == e).mean()), float((a == n).mean())))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    return got


def test_next_rows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(10**6), " ".join(f"é{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for _ in range(150)]
    check(spark, rows, 7)
    odd = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Aa 😀bb́ cc"), (5, "Aa 😀bb́ cc"), (5, "other text of the same id"), (None, "no id"), (None, "no id"), (None, None), (-3, "w " * 30_000), (9, "y")]
    got = check(spark, odd, 3)
    assert {r.near_next for r in got if r.doc_id == 1} == {1.0} and all(0 <= r.near_edited <= 1 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table")], [(1, None)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_copies_of_one_row_are_spread(spark):
    """Rows alike in id and text go to several ranges."""
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a copy of the same text").alias("text")).repartition(4)
    scratch = Scratch(spark, "t")
    assert x.beside_next(df, scratch).agg(F.min("near_next")).first()[0] == 1.0
    sizes = [r["n"] for r in spark.read.parquet(f"{scratch.root}/along").groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 2000


def test_operator_and_likeness(spark):
    """The general operator keeps other columns; its fingerprints compare by a native expression."""
    texts = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over a lazy dog", "The Quick brown fox jumps over the lazy dog", "", None]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "k int, body string, n int")
    made = x.fingerprinted(df, "body")
    assert made.columns == ["k", "n", "fingerprint"]
    pairs = made.alias("a").crossJoin(made.alias("b")).select("a.k", F.col("b.k").alias("l"), x.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("s"))
    got = {(r.k, r.l): r.s for r in pairs.collect()}
    assert got[0, 2] == got[3, 4] == 1.0 and got[0, 3] == 0.0 and abs(got[0, 1] - jaccard(texts[0], texts[1])) < 0.25
