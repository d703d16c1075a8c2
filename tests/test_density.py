"""Density clusters against a plain version that cuts the full graph at every distance."""

import numpy as np
import pytest

from oremill.operators import cluster, density


def plain(vectors, least=3):
    """Row to cluster from thresholds of the whole graph, top down; noise is left out."""
    n = len(vectors)
    if n < least:
        return {}
    u = np.array([np.asarray(v, float) / np.linalg.norm(v) for v in vectors])
    d = density.chords(u, u)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, least - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))

    def parts(rows, below):
        left, out = set(rows), []
        while left:
            seen, todo = set(), [min(left)]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for y in left - seen if reach[x, y] < below]
            out.append(sorted(seen))
            left -= seen
        return out

    def branch(rows, birth):
        """(worth, chosen clusters, own stability)"""
        all_rows, now, own = rows, rows, 0.0
        while True:
            inside = reach[np.ix_(now, now)]
            w = next(x for x in sorted(set(inside[~np.eye(len(now), dtype=bool)]), reverse=True) if len(parts(now, x)) > 1)
            at = 1 / max(w, density.NEAREST)
            big = [p for p in parts(now, w) if len(p) >= least]
            if len(big) == 1:
                own += (len(now) - len(big[0])) * (at - birth)
                now = big[0]
                continue
            own += len(now) * (at - birth)
            below = [branch(p, at) for p in big]
            worth, chosen = sum(b[0] for b in below), [c for b in below for c in b[1]]
            if birth > 0 and own >= worth - 1e-9 * abs(worth):
                return own, [all_rows]
            return worth, chosen

    return {r: min(c) for c in branch(list(range(n)), 0.0)[1] for r in c}


def blobs(seed, sizes, noise, dims=5, spread=0.08):
    rng = np.random.default_rng(seed)
    out = [c + spread * rng.standard_normal(dims) for k in sizes for c in [rng.standard_normal(dims)] for _ in range(k)]
    return [list(map(float, v)) for v in out + list(rng.standard_normal((noise, dims)))]


@pytest.mark.parametrize("seed", range(12))
def test_condensed_tree(seed):
    vectors = blobs(seed, (5 + seed, 9, 3 + seed % 4), 6 + seed)
    if seed % 3 == 0:  # copies, at distance zero
        vectors += [vectors[0]] * 5 + [vectors[-1]] * 2
    u = density._unit(vectors)
    d = density.chords(u, u)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, 2]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges = np.array(density.spanning_forest(w, True))
    got = density.condensed(edges[:, 0], edges[:, 1], w[edges[:, 0], edges[:, 1]], 3)
    assert got == plain(vectors) and len(set(got.values())) >= 2


def test_blocks_of_several_tiles(spark):
    held = {"one": blobs(1, (20, 12, 7), 20), "two": blobs(2, (9, 9), 5), None: blobs(3, (14, 6), 4), "copies": [[1.0, 2.0, 0.0]] * 40 + [[0.0, 1.0, 5.0]] * 30 + blobs(4, (6,), 5, 3), "few": [[1.0, 0.0]] * 2}
    rows = [(b, 100 + i, v, 7) for b, vs in held.items() for i, v in enumerate(vs)]
    odd = [("one", 1, None, 7), ("one", 2, [], 7), ("one", 3, [0.0] * 5, 7), ("one", 4, [float("nan")] * 5, 7), ("one", 5, [1.0, None, 1.0, 1.0, 1.0], 7), ("one", 6, [1.0, 2.0], 7)]
    df = spark.createDataFrame(rows + odd, "block string, ord int, embedding array<double>, cluster int")
    got = {(r.block, r.ord): (r.cluster, r.noise) for r in density.density_clusters(df, "block", tile=16).collect()}
    assert len(got) == len(rows) + len(odd)
    for b, vs in held.items():
        want = plain(vs)
        for i in range(len(vs)):
            assert got[(b, 100 + i)] == ((100 + want[i], False) if i in want else (100 + i, True)), (b, i)
    assert all(got[(b, i)] == (i, True) for b, i, *_ in odd)
    assert density.density_clusters(df.limit(0), "block").collect() == []


def test_what_is_sent_grows_with_the_rows(spark):
    """A larger block has no more tiles but larger ones, compared piece by piece, and the same clusters."""
    vectors = blobs(6, (30, 20, 12), 28) + [[1.0] * 5] * 10
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(vectors)], "block string, ord long, embedding array<double>")
    dealt = density.tiled(df, "block", tile=4)
    assert dealt.agg({"parts": "max"}).first()[0] == density.PARTS and density._units(dealt).count() == density.PARTS * len(vectors)
    want = plain(vectors)
    for most, piece in ((3, 7), (1, 16), (1, 1000)):
        got = {r.ord: (r.cluster, r.noise) for r in density.density_clusters(df, "block", tile=4, most=most, piece=piece).collect()}
        assert got == {i: (want.get(i, i), i not in want) for i in range(len(vectors))}


def test_dense_blocks_beside_greedy_ones(spark):
    thick, thin = blobs(5, (25, 15), 6), [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]]
    rows = [("thick", i, v) for i, v in enumerate(thick)] + [("thin", i, v) for i, v in enumerate(thin)] + [("alone", 0, [1.0])]
    df = spark.createDataFrame(rows, "block string, ord long, embedding array<double>")
    got = {(r.block, r.ord): r.cluster for r in cluster.clusters(df, 0.9, "block", dense=True).collect()}
    want = plain(thick)
    assert {i: c for (b, i), c in got.items() if b == "thick"} == {i: want.get(i, i) for i in range(len(thick))}
    assert [got[("thin", i)] for i in range(3)] == [0, 0, 1] and ("alone", 0) not in got
