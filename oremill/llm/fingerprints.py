"""Document fingerprints by consistent weighted sampling.

A text's terms are, for each of its words, the word with the up to four words before it, A-Z lower-cased; a term's weight is
how often it occurs.  So texts of five words and more are compared by their five-word shingles, and shorter ones by what they
begin with.  For each of SAMPLES samples, every term draws r and c from Gamma(2, 1) and b from [0, 1) by a hash of the term
and the sample's number alone.  With t = floor(ln w / r + b) its value is ln c - r (t + 1 - b); the term of the least value
is the sample, and (term, t) its identity.  Two texts draw the same identity with the probability of their generalised
Jaccard similarity, the sum of the lesser weights over the sum of the greater ones, so the share of equal samples estimates
it, with a standard deviation of at most 1 / (2 sqrt(SAMPLES)) = 0.0625.  A fingerprint holds sixteen bits of each identity.

Draws come from tables of the distribution's quantiles at 65,536 places and 32 further bits, evaluated over slices of terms
that stay in the processor's cache; weights above 1, which are few, are drawn again with their own t.

Defined results: null text reads as empty; a text without words has the fingerprint of zeros, which no text with words
shares; equal texts have equal fingerprints; rows that repeat are rows of their own; ids come in ascending order, nulls
last, and rows of one id in the order of a hash of their texts; a single row is its own next one; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORD, Scratch, byte_rows, flatten, join_hash, load, mix, narrowed, parts_for, word_bounds, word_hashes

SHINGLE = 5
SAMPLES = 64
BATCH_BYTES = 2 << 20
#: Terms drawn at a time: their arrays stay in the cache.
SLICE = 1 << 15
PART_BYTES = 32 << 20


# ---------------------------------------------------------------- terms
def terms(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each row's distinct terms in rising order, their weights, the n + 1 bounds of the rows)."""
    buf, offsets = flatten(texts)
    buf = LOWER[buf]
    starts, ends, bounds = word_bounds(buf, offsets, SPACE_WORD)
    words = word_hashes(buf, starts, ends)
    first = np.zeros(len(words), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    run = words
    for _ in range(shingle - 1):  # each word after the term of the word before it, which a row's first word has not
        longer = words.copy()
        at = np.flatnonzero(~first)
        longer[at] = join_hash(run[at - 1], words[at])
        run = longer
    run = run.copy() if run is words else run
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        run[a:b].sort()
    new = first
    new[1:] |= run[1:] != run[:-1]
    at = np.flatnonzero(new)
    return run[at], np.diff(np.append(at, len(run))), np.searchsorted(at, bounds)


# ---------------------------------------------------------------- samples
@lru_cache(1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) and its logarithm at 65,536 evenly spaced probabilities: the roots of 1 - (1 + x) e^-x = p."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


@lru_cache(1)
def _seeds(samples: int) -> np.ndarray:
    return mix((np.arange(samples, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _draw(hashes: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) of each term for the sample of that seed."""
    r, ln_c = _quantiles()
    x = hashes ^ seed
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    half = x.view(np.uint16).reshape(-1, 4)  # bits 32 to 47 choose r, 48 to 63 ln c, the lower half is b
    b = x.view(np.uint32)[::2].astype(np.float32)
    b *= np.float32(2.0**-32)
    return r[half[:, 2]], ln_c[half[:, 3]], b


def samples(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """The identities of `count` samples of each row, as uint16; zeros for rows without terms."""
    rows = len(bounds) - 1
    least, which, level = np.full((rows, count), np.inf, np.float32), np.zeros((rows, count), np.uint64), np.zeros((rows, count), np.int64)
    for at in range(0, len(hashes), SLICE):
        h, w = hashes[at : at + SLICE], weights[at : at + SLICE]
        one, more = int(np.searchsorted(bounds, at, "right")) - 1, int(np.searchsorted(bounds, at + len(h), "left"))
        own = np.arange(one, more)
        own = own[(np.minimum(bounds[own + 1], at + len(h)) > np.maximum(bounds[own], at))]  # rows with terms in the slice
        starts = np.maximum(bounds[own], at) - at
        sizes = np.diff(np.append(starts, len(h)))
        heavy = np.flatnonzero(w > 1)
        ln_w = np.log(w[heavy]).astype(np.float32)
        for i, seed in enumerate(_seeds(count)):
            r, value, b = _draw(h, seed)
            if len(heavy):
                t = np.floor(ln_w / r[heavy] + b[heavy])
            b -= np.float32(1)
            r *= b
            value += r  # ln c - r (1 - b), for weights of 1
            if len(heavy):
                value[heavy] -= (r[heavy] / np.where(b[heavy] == 0, np.float32(-1), b[heavy])) * t
            best = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == np.repeat(best, sizes))
            seg = np.searchsorted(starts, hit, "right") - 1
            hit = hit[np.r_[True, seg[1:] != seg[:-1]]]  # of equal values the smallest hash
            better = best < least[own, i]
            least[own[better], i], which[own[better], i] = best[better], h[hit[better]]
            if len(heavy):
                levels = np.zeros(len(h), np.int64)
                levels[heavy] = t
                level[own[better], i] = levels[hit[better]]
            else:
                level[own[better], i] = 0
    name = mix(which ^ (level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ _seeds(count)[None, :]) >> np.uint64(48)
    name = np.maximum(name, np.uint64(1)).astype(np.uint16)
    name[np.diff(bounds) == 0] = 0
    return name


def signatures(texts: pa.Array, shingle: int = SHINGLE, count: int = SAMPLES) -> np.ndarray:
    return samples(*terms(texts, shingle), count)


def hexed(names: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in names.astype(">u2")]


# ---------------------------------------------------------------- operators
def fingerprinted(df: DataFrame, text: str = "text", shingle: int = SHINGLE, count: int = SAMPLES) -> DataFrame:
    """`df` with `fingerprint`, four hexadecimal digits a sample; one pass without a shuffle."""

    def run(batches):
        for batch in byte_rows(BATCH_BYTES, batches):
            made = pa.array(hexed(signatures(batch.column(batch.schema.get_field_index("text")), shingle, count)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "fingerprint"])

    kept = [c for c in df.columns if c not in (text, "fingerprint")]
    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("text"))
    schema = given.drop("text").withColumn("fingerprint", F.lit("")).schema
    return given.mapInArrow(run, schema)


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints of one length agree."""
    n = F.length(a) / 4
    part = lambda x, i: F.substring(x, (i * 4 + 1).cast("int"), F.lit(4))
    same = F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: part(a, i) == part(b, i))
    return F.size(same) / n


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = "part int, kind int, body string, " + _OUT


def _compared(ids: list, texts: list[str], names: np.ndarray, afters: list[str], after_names: np.ndarray) -> list[pa.Array]:
    """The columns of _OUT for rows, their fingerprints, and the texts and fingerprints of the rows after them."""
    edited = [_edited(t, a) for t, a in zip(texts, afters)]
    made = signatures(pa.array(edited, pa.large_string()))
    share = lambda x: pa.array((names == x).mean(axis=1) if len(names) else [], pa.float64())
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array(hexed(names), pa.string()), pa.array(hexed(made), pa.string()), share(made), share(after_names),
    ]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's rows beside their next ones (kind 0), its first text (1) and its last row (2), which await others."""
    part, held = TaskContext.get().partitionId(), None
    names = [c.split()[0] for c in _KINDS.split(", ")]

    def edge(kind: int, doc_id, body: str) -> pa.RecordBatch:
        given = {"part": part, "kind": kind, "body": body, "doc_id": doc_id}
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([given.get(n)], k) for n, k in zip(names, kinds)], names=names)

    for batch in byte_rows(BATCH_BYTES, batches):
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        made = signatures(batch.column(1))
        if held is None:
            yield edge(1, None, texts[0])
        else:
            ids, texts, made = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], made])
        held = ids[-1], texts[-1], made[-1:]
        out = _compared(ids[:-1], texts[:-1], made[:-1], texts[1:], made[1:])
        n = len(ids) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.zeros(n), pa.int32()), pa.nulls(n, pa.string()), *out], names=names)
    if held is not None:
        yield edge(2, held[0], held[1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions (doc_id, text) beside the first text of the partition after them (after)."""
    names = [c.split()[0] for c in _OUT.split(", ")]
    for batch in batches:
        ids, texts, afters = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays(_compared(ids, texts, signatures(batch.column(1)), afters, signatures(batch.column(2))), names=names)


def beside_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row's fingerprint, that of its text with the second half replaced by the next row's beginning, and their likeness.

    Texts move once, to ranges of ids; rows of one id, alike or not, are spread over ranges.  A range's last row meets the
    first text of the next range in a join of as many rows as there are ranges.
    """
    rows = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").alias("h"), F.monotonically_increasing_id()]
    keyed = rows.withColumns({"h": order[1], "m": order[2]})
    keys = [order[0], F.col("h"), F.col("m")]
    ranges = keyed.repartitionByRange(parts_for(docs, PART_BYTES), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    held = scratch.put("along", ranges.mapInArrow(_along, _KINDS))
    heads = held.filter("kind = 1").select(F.col("part").alias("head"), F.col("body").alias("after"))
    ring = heads.select("head", F.coalesce(F.lag("head").over(Window.orderBy("head")), F.max("head").over(Window.partitionBy())).alias("before"))  # a row a range
    lasts = held.filter("kind = 2").select("part", "doc_id", F.col("body").alias("text"))
    met = lasts.join(ring, F.col("part") == F.col("before")).join(heads, "head").select("doc_id", "text", "after")
    names = [c.split()[0] for c in _OUT.split(", ")]
    return held.filter("kind = 0").select(*names).unionByName(met.mapInArrow(_across, _OUT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document."""
    with Scratch(spark, "fingerprints") as scratch:
        return scratch.finish(beside_next(load(spark, sf_dir, "documents"), scratch))


ORACLE = None  # sampling by hashes is no SQL: the tests compare with exact similarities and with a plain version
