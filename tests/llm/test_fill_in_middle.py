"""Fill-in-the-middle against slices of the text, its marks and odd rows.  The query has a SQL oracle besides."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from oremill.llm import fill_in_middle as x

SCHEMA = "doc_id long, text string, output int, form string, n string"


def check(spark, rows, plan=x.Plan()):
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA)
    made = x.fill_in_middle(df, plan).withColumn("back", x.restored(F.col("output"), F.col("form"), plan))
    got = sorted((str(r.doc_id), r.back, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in made.collect())
    assert [g[:2] for g in got] == sorted((str(d), t or "") for d, t in rows)
    return got


def plain_version(d, t):
    h = hashlib.sha256(f"1:{d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = list(t)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return len(units), "plain", None, None, t
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_against_slices(spark):
    texts = ["plain words only", "é😀́中\n\r\x00z", "a<", "<<P", "<S", "x<M>y", "<P>", "M>", "", "a", " \n", "<P<S<M" * 3, "long é " * 40_000]
    rows = [(100 * k + i, t) for i, t in enumerate(texts) for k in range(8)]
    got = check(spark, rows)
    assert [g[2:] for g in got] == [plain_version(d, t) for d, t in sorted(rows, key=lambda r: (str(r[0]), r[1]))]
    assert {g[3] for g in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    got = check(spark, [(None, "null id"), (None, None), (5, None), (6, "same"), (6, "same"), (-7, "minus")])
    assert [g[2] for g in got if g[0] == "6"] == [4, 4] and all(g[3] == "plain" for g in got if g[1] == "")
    assert check(spark, []) == []


def test_other_units(spark):
    """Words as units: what lies between two words belongs to the part before the next one."""
    got = check(spark, [(i, "one two  three four five") for i in range(40)] + [(99, "   ")], x.Plan(unit=r"\S+", changed=100, suffix_first=50))
    assert {g[2] for g in got} == {5, 0} and {g[3] for g in got} == {"psm", "spm"}
    for _, text, n, form, a, m, out in got:
        prefix = re.search(r"<P>(.*?)<[SM]>", out)[1]
        assert len(prefix.split()) == a and len(out.split("<M>")[1].split()) == m and (text.startswith(prefix))


def test_matches_are_not_held():
    """The iterator is advanced to the second rank and no further."""
    seen = []

    class Unit:
        def finditer(self, text):
            for m in re.finditer(".", text):
                seen.append(m.end())
                yield m

    assert x.unit_ends("abcdefgh", Unit(), 2, 5) == (2, 5) and seen == [1, 2, 3, 4, 5]
    assert x.unit_ends("abc", re.compile("."), 0, 0) == (0, 0) and x.n_units("abc", re.compile(".")) == 3


def test_marks_that_cannot_be_told_apart():
    for marks in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "<P>>", "<M>"), ("ab", "ba", "<M>"), ("aa", "<S>", "<M>")):
        with pytest.raises(ValueError):
            x.Plan(prefix=marks[0], suffix=marks[1], middle=marks[2])
