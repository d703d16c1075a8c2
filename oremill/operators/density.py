"""Density clusters of vectors: core distances, minimum spanning trees by Boruvka rounds, condensed trees.

The distance of two rows is the chord between their unit vectors, rounded to seven places; their reachability is the
largest of it and of both rows' core distances, a core distance being that to the `least`-th nearest row, the row itself
counted.  Clusters are those of greatest total stability in the condensed hierarchy (excess of mass), the whole block
never being one; rows outside all of them are noise.

Vectors meet by tiles, every unordered pair of tiles of a block being a unit of work.  A unit holds two tiles and gives, in
one pass, the nearest rows of each row and, in another, the minimum spanning forest of its own pairs: a pair in no such
forest is the longest of a cycle, so it is in no spanning tree of the block that is needed.  Boruvka rounds take the
tree from the forests, as joins and minima.  Equal distances merge together, which leaves the hierarchy the same
whichever of several trees was found.

What a block has in one task is its tree, three numbers a row; vectors are never in one task beyond two tiles.  Each row is sent
once a tile of its block.  A block has PARTS tiles at most while they stay below TILE_BYTES, so that what is sent grows with the
rows; tiles are compared piece by piece.  Pairs are compared once, so that arithmetic grows with the square of a block.

Defined results: rows without a vector, with a null or non-finite component, or of no length stay alone; vectors of
different lengths are apart, as if in blocks of their own; copies of one vector are at distance zero and count as rows; an
empty table gives an empty result; a null block is a block; extra columns are ignored.  `ord` tells the rows of a block apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import TILE, _unit

LEAST = 3
#: Distances below this one count as this one where a density, its inverse, is asked for.
NEAREST = 1e-6
#: A block is dealt to this many tiles at most, and to more only where a tile's vectors would take over TILE_BYTES.
PARTS = 8
TILE_BYTES = 32 << 20
#: So many rows of either side are compared at once.
PIECE = 1024


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors; those of equal vectors are zero."""
    return np.round(np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0)), 7)


def _group(block: str) -> Column:
    """The block and the length of its vectors, as one text."""
    return F.to_json(F.struct(F.col(block).alias("block"), F.size("embedding").alias("dims")))


def tiled(rows: DataFrame, block: str, least: int = LEAST, tile: int = TILE, most: int = PARTS) -> DataFrame:
    """(g, tile, parts, ord, embedding): rows that take part, dealt to `most` tiles of their block, fewer where `tile` rows are one."""
    sound = F.forall("embedding", lambda x: F.coalesce(x.between(-1e300, 1e300), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    kept = rows.filter(F.size("embedding") > 0).filter(sound).select(_group(block).alias("g"), F.col("ord").cast("long").alias("ord"), "embedding")
    count = kept.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dims")).filter(F.col("n") >= least)
    parts = F.greatest(F.least(F.ceil(F.col("n") / tile), F.lit(most)), F.ceil(F.col("n") * F.col("dims") * 8 / TILE_BYTES))
    sized = kept.join(count.select("g", parts.cast("int").alias("parts")), "g")
    return sized.withColumn("tile", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int"))


def _units(dealt: DataFrame) -> DataFrame:
    pair = lambda other: F.struct(F.least("tile", other).alias("x"), F.greatest("tile", other).alias("y"))
    return dealt.withColumn("unit", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)))


def _pieces(rows: int, cols: int, same: bool, piece: int) -> Iterator[tuple[slice, slice, bool]]:
    """Slices of two sides that cover their pairs, or each unordered pair once where the sides are the `same`."""
    for i in range(0, rows, piece):
        for j in range(i if same else 0, cols, piece):
            yield slice(i, min(i + piece, rows)), slice(j, min(j + piece, cols)), same and i == j


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    unit = pdf["unit"].iloc[0]
    pdf = pdf.sort_values("ord", kind="stable")
    return pdf[pdf["tile"] == unit["x"]], pdf[pdf["tile"] == unit["y"]], unit["x"] == unit["y"]


def core_distances(dealt: DataFrame, least: int = LEAST, piece: int = PIECE) -> DataFrame:
    """(g, ord, core) of the rows of `tiled`."""
    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        sides = (left,) if same else (left, right)
        units = [_unit(side["embedding"]) if len(side) else np.zeros((0, 0)) for side in sides]
        near = [np.full((len(side), least), np.inf) for side in sides]

        def closer(k: int, at: slice, d: np.ndarray) -> None:
            m = np.concatenate([near[k][at], np.partition(d, least - 1, axis=1)[:, :least] if d.shape[1] > least else d], axis=1)
            near[k][at] = np.partition(m, least - 1, axis=1)[:, :least]

        for i, j, diagonal in _pieces(len(left), len(right), same, piece):
            d = chords(units[0][i], units[-1][j])
            if diagonal:
                np.fill_diagonal(d, 0.0)
            closer(0, i, d)
            if not diagonal:
                closer(0 if same else 1, j, np.ascontiguousarray(d.T))
        held = [side["ord"].to_numpy(np.int64) for side in sides]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * sum(map(len, held)), "ord": np.concatenate(held), "near": [v for m in near for v in m]})

    near = _units(dealt).groupBy("g", "unit").applyInPandas(nearest, "g string, ord long, near array<double>")
    # a row has `least` numbers a tile of its block; a tile of fewer rows fills up with infinity
    return near.groupBy("g", "ord").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), least).alias("core"))


def spanning_forest(w: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Pairs (row, column) of a minimum spanning tree of the graph of `w`: two sides, or one where `same`."""
    rows, cols = w.shape
    if not rows or not cols:
        return []
    shift = 0 if same else rows
    n = cols + shift
    best, via, out, done = np.full(n, np.inf), np.zeros(n, np.int64), [], np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        done[at] = True
        if same:
            near, span = w[at], slice(0, n)
        else:
            near, span = (w[at], slice(rows, n)) if at < rows else (w[:, at - rows], slice(0, rows))
        closer = (near < best[span]) & ~done[span]
        best[span][closer] = near[closer]
        via[span][closer] = at
        at = int(np.where(done, np.inf, best).argmin())
        i, j = sorted((int(via[at]), at))
        out.append((i, j - shift))
    return out


def lightest(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges (i, j, w) that make a minimum spanning forest of them."""
    up, kept = list(range(int(max(i.max(), j.max())) + 1 if len(w) else 0)), []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    order = np.argsort(w, kind="stable")
    for e, p, q in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        x, y = find(p), find(q)
        if x != y:
            up[y] = x
            kept.append(e)
    return np.array(kept, np.int64)


def forests(dealt: DataFrame, cores: DataFrame, piece: int = PIECE) -> DataFrame:
    """(g, a, b, w, more), a < b: edges of each unit's minimum spanning forest by reachability; `more`: g has several tiles.

    A unit's forest is that of its pieces' forests, which are thinned whenever they are eight edges a row.
    """
    def spanned(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        shift = 0 if same else len(left)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            u, v = _unit(left["embedding"]), _unit(right["embedding"])
            cu, cv = left["core"].to_numpy(), right["core"].to_numpy()
        for r, c, diagonal in _pieces(len(left), len(right), same, piece):
            w = np.maximum(chords(u[r], v[c]), np.maximum(cu[r][:, None], cv[c][None, :]))
            edges = np.array(spanning_forest(w, diagonal), np.int64).reshape(-1, 2)
            held.append((edges[:, 0] + r.start, edges[:, 1] + c.start + shift, w[edges[:, 0], edges[:, 1]]))
            if sum(len(h[2]) for h in held) > 8 * (len(pdf) + piece):
                held = thinned(held)
        if len(held) > 2:
            held = thinned(held)
        i, j, w = (np.concatenate(x) for x in zip(*held))
        p, q = left["ord"].to_numpy(np.int64)[i], right["ord"].to_numpy(np.int64)[j - shift]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(w), "a": np.minimum(p, q), "b": np.maximum(p, q), "w": w, "more": [bool(pdf["parts"].iloc[0] > 1)] * len(w)})

    def thinned(held: list) -> list:
        i, j, w = (np.concatenate(x) for x in zip(*held))
        at = lightest(i, j, w)
        return [(i[at], j[at], w[at])]

    return _units(dealt.join(cores, ["g", "ord"])).groupBy("g", "unit").applyInPandas(spanned, "g string, a long, b long, w double, more boolean")


def _roots(link: DataFrame, save) -> DataFrame:
    """(g, c, to) with `to` the end of each way of links: ways are halved each round."""
    while True:
        onward = link.select("g", F.col("c").alias("to"), F.col("to").alias("next"))
        link = save(link.join(onward, ["g", "to"]).select("g", "c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if link.filter("moved").isEmpty():
            return link.select("g", "c", "to")
        link = link.select("g", "c", "to")


def spanning_trees(edges: DataFrame, save) -> DataFrame:
    """(g, a, b, w): a minimum spanning tree of each g from edges that hold one, by Boruvka rounds.

    Each component takes its least edge by (w, a, b), so links form no cycle but pairs, whose smaller end is the root.
    """
    live = save(edges.select("g", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    taken = None
    while not live.isEmpty():
        ends = live.select("g", "w", "a", "b", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to")))).alias("e"))
        best = save(ends.groupBy("g", F.col("e.c").alias("c")).agg(F.min(F.struct("w", "a", "b", F.col("e.to").alias("to"))).alias("m")).select("g", "c", "m.*"))
        chosen = best.select("g", "a", "b", "w").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        back = best.select("g", F.col("c").alias("to"), F.col("to").alias("back"))
        link = best.select("g", "c", "to").join(back, ["g", "to"])
        root = _roots(link.select("g", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")), save)
        for side in ("ca", "cb"):
            live = live.join(root.select("g", F.col("c").alias(side), F.col("to").alias(f"{side}2")), ["g", side]).drop(side).withColumnRenamed(f"{side}2", side)
        live = save(live.filter("ca <> cb").select("g", "a", "b", "w", "ca", "cb"))
    return edges.select("g", "a", "b", "w").limit(0) if taken is None else taken


def condensed(a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> dict[int, int]:
    """Row to cluster, its smallest row, from the edges of a spanning tree; noise is left out."""
    up: dict[int, int] = {}
    size: dict[int, int] = {}
    loose: dict[int, list[int]] = {}  # rows of components too small to be clusters
    node: dict[int, int] = {}  # the cluster a component is now
    parent, sums, count, stable, children, first = [], [], [], [], [], {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    order = np.argsort(w, kind="stable")
    a, b, w = a[order], b[order], w[order]
    start = 0
    while start < len(w):
        end = int(np.searchsorted(w, w[start], "right"))
        density = 1.0 / max(float(w[start]), NEAREST)
        met: dict[int, set[int]] = {}
        for i in range(start, end):
            x, y = find(int(a[i])), find(int(b[i]))
            if x == y:
                continue
            mx, my = met.pop(x, {x}), met.pop(y, {y})
            up[y] = x
            met[x] = mx | my
        for root, members in met.items():
            total = sum(size.get(m, 1) for m in members)
            rows = [r for m in members if m not in node for r in loose.pop(m, [m])]
            big = sorted(node.pop(m) for m in members if m in node)
            size[root] = total
            if len(big) == 1:
                at = big[0]
                sums[at] += len(rows) * density
                count[at] += len(rows)
            elif big or total >= least:
                at = len(parent)
                parent.append(-1)
                sums.append(total * density)
                count.append(total)
                stable.append(0.0)
                children.append(big)
                for c in big:
                    parent[c] = at
                    stable[c] = sums[c] - count[c] * density
            else:
                loose[root] = rows
                continue
            node[root] = at
            for r in rows:
                first[r] = at
        start = end

    held, worth = [False] * len(parent), [0.0] * len(parent)
    for c in range(len(parent)):  # children stand before their parents
        below = sum(worth[k] for k in children[c])
        held[c] = parent[c] >= 0 and stable[c] >= below
        worth[c] = stable[c] if held[c] else below
    top = [-1] * len(parent)
    for c in reversed(range(len(parent))):
        above = top[parent[c]] if parent[c] >= 0 else -1
        top[c] = above if above >= 0 else c if held[c] else -1
    name: dict[int, int] = {}
    for r, c in first.items():
        if top[c] >= 0:
            name[top[c]] = min(r, name.get(top[c], r))
    return {r: name[top[c]] for r, c in first.items() if top[c] >= 0}


def density_clusters(rows: DataFrame, block: str, save=lambda df: df.checkpoint(), least: int = LEAST, tile: int = TILE, most: int = PARTS, piece: int = PIECE) -> DataFrame:
    """(block, ord, cluster, noise): `cluster` is the smallest ord of the row's cluster, its own where it is noise.

    `save` writes a table and reads it back (a `Scratch.put`); by default a checkpoint.
    """
    dealt = save(tiled(rows, block, least, tile, most))
    edges = save(forests(dealt, save(core_distances(dealt, least, piece)), piece))
    # a block of one tile has its tree already
    trees = edges.filter("NOT more").select("g", "a", "b", "w").unionByName(spanning_trees(edges.filter("more"), save))
    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        found = condensed(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), least)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(found), "ord": list(found), "cluster": list(found.values())})

    found = trees.groupBy("g").applyInPandas(named, "g string, ord long, cluster long")
    every = rows.select(F.col(block), F.col("ord").cast("long").alias("ord"), _group(block).alias("g"))
    return every.join(found, ["g", "ord"], "left").select(block, "ord", F.coalesce("cluster", "ord").alias("cluster"), F.col("cluster").isNull().alias("noise"))
