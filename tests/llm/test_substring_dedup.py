"""Substring de-duplication against brute force."""

import random

import pytest

from oremill.llm import substring_dedup
from oremill.llm.common import Scratch
from tests.llm.confusing import PAIR


def brute(rows, window):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            g = tuple(words[i : i + window])
            if g in seen:
                gone |= set(range(i, i + window))
            seen.add(g)
        out.append((doc, len(words), len(gone), " ".join(w.decode() for i, w in enumerate(words) if i not in gone)))
    return out


def check(spark, rows, window=20):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    got = substring_dedup.substring_dedup(df, Scratch(spark, "t"), window).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=key) == sorted(brute(rows, window), key=key)
    for r in got:
        assert sum(b - a for a, b in r.removed) == r.n_removed


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    rng = random.Random(seed)
    passages = [[f"p{i}w{j}" for j in range(rng.randint(10, 60))] for i in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice([rng.choice(passages), ["of"] * rng.randint(1, 50), [rng.choice("abc") for _ in range(rng.randint(1, 30))], [f"u{rng.random()}"] * 3])
        rows.append((i, "  ".join(words)))
    check(spark, rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (4, "a b c"), (5, long), (6, long), (None, "x y " * 30), (7, "x y " * 30), (7, "x y " * 30), (8, "é à " * 25), (9, " ".join("t" * 19))]
    check(spark, rows)
    check(spark, rows, window=3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(df, Scratch(spark, "t")).collect() == []


def test_words_that_simple_sums_confuse(spark):
    head = " ".join(f"w{i}" for i in range(19))
    check(spark, [(1, f"{head} {PAIR[0]}"), (2, f"{head} {PAIR[1]}"), (3, f"{head} {PAIR[0]}")])


def test_rows_of_one_id_are_dealt_over_chunks(spark, monkeypatch):
    """Of texts under one id exactly one keeps a shared passage, whichever chunks they lie in."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    shared = " ".join(f"s{i}" for i in range(25))
    for doc in (None, 7):
        df = spark.createDataFrame([(doc, f"own{i} {shared}") for i in range(40)], "doc_id long, text string")
        got = substring_dedup.substring_dedup(df, Scratch(spark, "t")).collect()
        assert sorted(r.n_removed for r in got) == [0] + [25] * 39 and {r.doc_id for r in got} == {doc}
