"""Mixing: water-filled targets, takes near them, and edge cases.  The query has a SQL oracle besides."""

from collections import defaultdict

import pytest

from oremill.llm import mixing
from oremill.llm.common import Scratch


def water(sizes, budget=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = budget * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def mix(spark, rows):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, source string, text string, size int, target string")
    return mixing.plan_mix(mixing.size_table(df, scratch), scratch).collect()


@pytest.mark.parametrize("shares", [(500, 30, 200, 10), (40, 400, 40, 5), (100, 100, 100, 100)])
def test_targets_and_takes(spark, shares):
    rows = []
    for s, n in zip(("a", "b", "c", None), shares):
        rows += [(len(rows) + i, s, "w " * (1 + (i * 7) % 23)) for i in range(n)]
    got = mix(spark, rows)
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, 0
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest = max(largest, r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = water(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 2 * largest
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mix(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edges(spark):
    rows = [(1, "a", None), (2, "a", ""), (None, None, "x y"), (3, "b", "t " * 50_000), (3, "b", "t " * 3), (3, "b", "t " * 3), (4, None, "q")]
    got = mix(spark, rows)
    assert len(got) == len(rows) and sum(r.size for r in got) == 50_009
    assert all(r.taken <= 2 * r.size for r in got)
    assert {r.target for r in mix(spark, rows[:2])} == {0.0}
    assert mix(spark, []) == []


def test_a_hot_group_is_queued_like_rows_one_by_one(spark):
    """20,000 rows without an id and 9,000 of one id, of one size: as many rows, takes and words as a plain queue gives."""
    scratch = Scratch(spark, "t")
    hot = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a' AS source", "3L AS size")
    same = spark.range(9_000).selectExpr("7L AS doc_id", "'b' AS source", "5L AS size")
    rest = spark.range(100, 1_100).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'a', 'b') AS source", "1 + id % 11 AS size")
    sized = scratch.put("sized", hot.union(same).union(rest))
    got = mixing.plan_mix(sized, scratch).collect()
    assert len(got) == 30_000 and sum(r.doc_id is None for r in got) == 20_000 and sum(r.doc_id == 7 for r in got) == 9_000
    sums = {s: sum(r.size for r in got if r.source == s) for s in "ab"}
    for s in "ab":
        rows = [r for r in got if r.source == s]
        assert {r.source_size for r in rows} == {sums[s]}
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 22
        # every place of the source's queue is taken by exactly one row
        ends, at = sorted((round(r.finish1 * r.target), r.size) for r in rows), 0
        for end, size in ends:
            at += size
            assert end == at
    groups = spark.createDataFrame([(None, 2, 2 * mixing.CHUNK_ROWS + 5), (1, 2, 1), (2, 2, mixing.CHUNK_ROWS)], "doc_id long, size long, n long")
    out = mixing.each_row(groups).groupBy("doc_id").agg({"nth": "max", "size": "count"}).collect()
    assert {(r.doc_id, r["max(nth)"], r["count(size)"]) for r in out} == {(None, 2 * mixing.CHUNK_ROWS + 4, 2 * mixing.CHUNK_ROWS + 5), (1, 0, 1), (2, mixing.CHUNK_ROWS - 1, mixing.CHUNK_ROWS)}
