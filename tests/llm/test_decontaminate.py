"""Decontamination against brute force.  The query has a SQL oracle besides."""

import random
import re

from oremill.llm import decontaminate as d
from oremill.llm.common import Scratch
from tests.llm.confusing import PAIR

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for a in range(max(min(len(v), 1), len(v) - 12)):
            g = v[a : a + 13]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add("null" if i is None else str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def check(spark, docs, items):
    df = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, hit int")
    it = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, n_words string")
    got = d.decontaminate(df, it, Scratch(spark, "t")).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=key) == sorted(((i, *brute(t, items)) for i, t in docs), key=key)


def cases():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 12, 13, 14, 40])))) for i in range(12)] + [(50, ""), (51, None), (52, "!!"), (None, "null item here"), (3, "same id, other words " * 5), (60, "of of of " * 8)]
    docs = [(1, None), (2, ""), (3, " .. "), (4, "v1"), (4, "v1"), (None, "null item here")]
    for i in range(40):
        t = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 5))
            t[rng.randint(0, len(t)) : 0] = w[a : a + rng.randint(5, 30)]
        docs.append((100 + i, "".join(x.upper() + rng.choice([" ", "-", ", ", "\n"]) if rng.random() < 0.3 else x + " " for x in t)))
    docs += [(900, "of " * 300), (901, "é v1, À;v2 " * 2000)]
    return docs, items


def test_against_brute_force(spark):
    check(spark, *cases())


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    check(spark, *cases())


def test_empty(spark):
    docs, items = cases()
    check(spark, docs, [])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect() == []


def test_long_items_are_cut_to_pieces(spark, monkeypatch):
    monkeypatch.setattr(d, "PIECE", 20)
    check(spark, *cases())


def test_words_that_simple_sums_confuse(spark):
    check(spark, [(1, PAIR[0]), (2, PAIR[1]), (3, "x " + PAIR[1])], [(1, PAIR[1])])


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "some words here", "mine", "own", 5)], "doc_id long, text string, hit string, items string, n_words int")
    it = spark.createDataFrame([(7, "words here")], "item_id long, text string")
    row = d.decontaminate(df, it, Scratch(spark, "t"), keep_text=True).collect()[0]
    assert (row.doc_id, row.text, row.n_words, row.n_hit, list(row["items"])) == (1, "some words here", 3, 2, ["7"])
