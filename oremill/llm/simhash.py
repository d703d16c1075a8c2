"""Near-duplicates by SimHash: exact comparison of fingerprints in tiles.

1. Each document gets a 64-bit fingerprint: the majority of every bit over the XXH64 hashes of its word shingles.
2. Equal fingerprints become one row, by aggregation, so groups of exact copies cost nothing further.
3. Fingerprints are laid in tiles by the population counts of their four 16-bit words.  Two fingerprints within the
   radius have counts that differ by no more than the radius in sum, so only such pairs of tiles are compared, with
   numpy exclusive-or and bit counts.  Only tiles beyond TILE rows are split, each by its own size; a unit of work holds
   one part of a tile and one part of each of its neighbours, and gives a forest of its links, never all pairs.
4. Connected components of the links.

Defined results: null and word-less texts have fingerprint 0 and are linked like others; fewer words than a shingle
make one shingle of the whole sequence; rows that repeat a doc_id are judged each; a component whose doc_ids are all
null has a null id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORD, Scratch, byte_rows, flatten, load, narrowed, settle, word_bounds
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 4096
SLICE_BYTES = 2 << 20
UNIT_BYTES = 16 << 20
PAIRS = 1 << 21


# ---------------------------------------------------------------- fingerprints
def majority(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each row, the bits that are set in over half of hashes[cuts[i]:cuts[i + 1]]; 0 for rows without any.

    Bits are added up eight at a time in byte lanes, over runs of at most 255 hashes, then over the runs of a row.
    """
    n = np.diff(cuts)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    runs = -(-n[full] // 255)
    run_row = np.repeat(np.arange(len(full)), runs)
    first_run = np.cumsum(runs) - runs
    begin = cuts[:-1][full][run_row] + 255 * (np.arange(len(run_row)) - first_run[run_row])
    for j in range(8):
        lanes = (hashes >> np.uint64(j)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(sums, first_run, axis=0)
        for lane in range(8):
            out[full] |= (2 * counts[:, lane] > n[full]).astype(np.uint64) << np.uint64(8 * lane + j)
    return out


def shingle_spans(bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every shingle of every row, and the rows' offsets among the shingles."""
    n = np.diff(bounds)
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    cuts = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = bounds[:-1][row] + np.arange(cuts[-1]) - cuts[:-1][row]
    return first, first + np.minimum(n, shingle)[row] - 1, cuts


def fingerprints(col, shingle: int = SHINGLE) -> np.ndarray:
    buf, offsets = flatten(col)
    buf = LOWER[buf]
    starts, ends, bounds = word_bounds(buf, offsets, SPACE_WORD)
    # the words again, each with one space behind it, so that a shingle is one stretch of bytes
    inside = SPACE_WORD[buf]
    inside[ends[ends < len(buf)]] = True
    joined = np.full(int((ends - starts).sum()) + len(starts), 0x20, np.uint8)
    at = np.cumsum(ends - starts + 1) - (ends - starts + 1)
    to = np.repeat(at - starts, ends - starts) + np.flatnonzero(SPACE_WORD[buf])
    joined[to] = buf[SPACE_WORD[buf]]
    first, last, cuts = shingle_spans(bounds, shingle)
    raw, stop = joined.tobytes(), at + (ends - starts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), stop[last].tolist())), np.uint64, len(first))
    return majority(hashes, cuts)


def _fingerprint(shingle: int):
    def run(batches):
        for batch in byte_rows(SLICE_BYTES, batches):
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(fingerprints(batch.column("text"), shingle).view(np.int64))], names=[*names, "fp"])

    return run


# ---------------------------------------------------------------- tiles
def steps(radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps between tiles whose four population counts differ by at most `radius` in sum."""
    ball = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in ball if d >= (0, 0, 0, 0)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == root).all():
            return root
        root = new


def unit_links(own: np.ndarray, near: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected by distances of at most `radius` between `own` and `near` (and inside own)."""
    nodes = np.concatenate([own, near])
    step = max(1, PAIRS // max(1, len(nodes)))
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(own), step):
        close = np.bitwise_count(own[i : i + step, None] ^ nodes[None, :]) <= radius
        x, y = np.nonzero(close)
        x += i
        keep = x < y
        a, b = np.concatenate([a, x[keep]]), np.concatenate([b, y[keep]])
        if len(a) > 4 * len(nodes):
            root = forest(len(nodes), a, b)
            a = np.flatnonzero(root != np.arange(len(nodes)))
            b = root[a]
    return nodes[a], nodes[b]


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table["unit"].to_numpy()
        order = np.argsort(keys, kind="stable")
        own, rows = table["own"].to_numpy(zero_copy_only=False)[order], table["fps"].to_pylist()
        cuts = np.append(np.flatnonzero(np.diff(keys[order], prepend=keys[order][0] - 1)), len(keys))
        us, vs = [], []
        for c, d in zip(cuts[:-1], cuts[1:]):
            parts = {True: [], False: []}
            for i in range(c, d):
                parts[bool(own[i])].append(rows[order[i]])
            if parts[True]:
                mine, near = (np.frombuffer(b"".join(parts[k]), np.uint64) for k in (True, False))
                u, v = unit_links(mine, near, radius)
                us.append(u)
                vs.append(v)
        join = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))
        out = pa.table({"u": join(us), "v": join(vs)})
        settle()
        return out

    return run


def _pack(batches):
    for batch in batches:
        lists = batch.column(2)
        flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], names=["tile", "part", "fps"])


def links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) with the components of all pairs within the radius."""
    spark = scratch.spark
    pops = [F.bit_count(F.shiftrightunsigned(F.col("fp"), 16 * w).bitwiseAND(F.lit(0xFFFF))) for w in range(4)]
    code = sum((p.cast("long") * 32 ** (3 - w) for w, p in enumerate(pops)), F.lit(0).cast("long"))
    tiled = prints.select(code.alias("tile"), "fp")
    # there are at most 17^4 tiles, so tables of a row a tile can be broadcast
    sizes = scratch.put("sizes", tiled.groupBy("tile").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / tile).cast("long")))
    widest, total = sizes.agg(F.max("parts"), F.sum("rows")).first()
    widest = widest or 1
    shift = [sum(x * 32 ** (3 - w) for w, x in enumerate(d)) for d in steps(radius)]
    around = F.explode(F.array(*[F.lit(s).cast("long") for s in shift]))
    own = sizes.select(F.col("tile").alias("here"), "parts")
    tiles = tiled.join(F.broadcast(own), F.col("tile") == F.col("here")).groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")).agg(F.collect_list("fp").alias("fps"))
    tiles = scratch.put("tiles", tiles.mapInArrow(_pack, "tile long, part long, fps binary"))
    # a unit (tile, part of it, part of its neighbours): own rows in each of its units, a neighbour's rows in one for each part of the tile
    number = lambda t, i, j: (t * widest + i) * widest + j
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    near = sizes.select(around.alias("s"), (F.col("tile") - F.col("s")).alias("to"), "parts").join(F.broadcast(sizes.select(F.col("tile").alias("to"))), "to")
    reach = near.groupBy("to").agg(F.max("parts").alias("reach"))
    mine = tiles.join(F.broadcast(reach), F.col("tile") == F.col("to")).select(F.explode(F.transform(each(F.col("reach")), lambda j: number(F.col("tile"), F.col("part"), j))).alias("unit"), F.lit(True).alias("own"), "fps")
    others = tiles.select("part", "fps", around.alias("s"), (F.col("tile") - F.col("s")).alias("to")).join(F.broadcast(own), F.col("to") == F.col("here"))
    others = others.select(
        F.explode(F.transform(F.filter(each(F.col("parts")), lambda i: (F.col("s") != 0) | (i < F.col("part"))), lambda i: number(F.col("to"), i, F.col("part")))).alias("unit"), F.lit(False).alias("own"), "fps"
    )
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((total or 0) * 8 * (len(shift) + 1) * min(widest, 64) // UNIT_BYTES) + 1)
    return mine.unionByName(others).groupBy(F.pmod(F.xxhash64("unit"), F.lit(groups)).alias("g")).applyInArrow(_compare(radius), "u long, v long")


# ---------------------------------------------------------------- operator
def fingerprinted(docs: DataFrame, *also: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the long columns `also` and fp of each row."""
    rows = narrowed(docs, "doc_id", *also, "text").select(F.col("doc_id").cast("long").alias("doc_id"), *also, "text")
    return rows.mapInArrow(_fingerprint(shingle), ", ".join(f"{c} long" for c in ("doc_id", *also, "fp")))


def named_components(rows: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint of `rows` (fp2) with the least fingerprint (root) and the least doc_id (component_id) of its component."""
    prints = scratch.put("prints", rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.put("links", links(prints, scratch, radius))
    roots = components(edges, scratch)
    known = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.select("fp", "root").join(ids, "root").select(F.col("fp").alias("fp2"), "root", "component_id")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document row: doc_id, fp (the fingerprint as a signed long), component_id."""
    rows = scratch.put("fingerprints", fingerprinted(docs, shingle=shingle))
    return rows.join(named_components(rows, scratch, radius), F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document."""
    with Scratch(spark, "simhash") as scratch:
        found = near_duplicates(load(spark, sf_dir, "documents"), scratch)
        return scratch.finish(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


ORACLE = None  # XXH64 is no SQL function; the tests compare with brute force
