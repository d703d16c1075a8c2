"""Exact de-duplication by a Golomb-coded exchange of fingerprints.

1. Every task normalises its texts (A-Z lower-cased, null as empty) and digests them, slice by slice.  A slice is
   written once, into a table clustered by its number without an exchange: its texts, their digests in sorted order.
2. Each slice sends every owner, by the fingerprints' leading bits, its distinct 64-bit fingerprints, the differences of
   the sorted values in Golomb-Rice code, each with one bit that says whether the slice has it more than once.  Owners
   decode and answer each slice with a bitmap of the fingerprints that occur more than once in all.
3. A slice meets its bitmaps where its texts lie.  Only the rows they mark (suspects) leave it with their texts, to be
   grouped byte by byte.

No group of copies meets in one task: a slice names a fingerprint once, and texts are grouped with map-side combination
and one row a distinct text.

Defined results: null text equals empty text and each of those rows belongs to one group; a null doc_id ranks below
all others; of rows that repeat both doc_id and text one stays; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, byte_rows, flatten, load, narrowed, parts_for, ragged_arange

SLICE_BYTES = 4 << 20
ROWS_PER_OWNER = 1 << 20


# ---------------------------------------------------------------- Golomb-Rice code
def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted unsigned 64-bit values as (remainder bits k, code of their differences): unary quotients, then remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / len(values) if len(values) else 0
    k = max(0, int(np.log2(mean))) if mean >= 1 else 0
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(n: int, k: int, code: bytes) -> np.ndarray:
    raw = np.frombuffer(code, np.uint8)
    rest_bytes = (n * k + 7) // 8
    ones = np.flatnonzero(np.unpackbits(raw[: len(raw) - rest_bytes]))[:n]
    quotient = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(raw[len(raw) - rest_bytes :])[: n * k].reshape(n, k).astype(np.uint64)
    rest = (bits << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)


def owner_cuts(values: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's share begins and ends in sorted fingerprints: owner = leading 32 bits * owners / 2^32."""
    lead = (values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
    return np.searchsorted(lead, np.arange(owners + 1, dtype=np.uint64))


# ---------------------------------------------------------------- executors' parts
SLICES = "slice long, kind int, ids binary, nulls binary, shas binary, sizes binary, texts binary"
PRINTS, TEXTS = range(2)


def _digest(batches):
    """Two rows a slice: digests of its texts in sorted order, and doc_ids and normalised texts in the same order."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for batch in byte_rows(SLICE_BYTES, batches):
        buf, offsets = flatten(batch.column(1))
        low = LOWER[buf]
        raw = low.tobytes()
        shas = np.frombuffer(b"".join(hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint8).reshape(-1, 32)
        order = np.argsort(_prints(shas), kind="stable")
        size = np.diff(offsets)[order]
        texts = low[np.repeat(offsets[:-1][order], size) + ragged_arange(size)] if len(low) else low
        nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = lambda *values: [pa.array([v], pa.binary()) for v in values]
        name = pa.array([part * (1 << 32) + k])
        for kind, values in ((PRINTS, (None, None, shas[order].tobytes(), None, None)), (TEXTS, (ids[order].tobytes(), nulls[order].tobytes(), shas[order].tobytes(), size.tobytes(), texts.tobytes()))):
            yield pa.RecordBatch.from_arrays([name, pa.array([kind], pa.int32()), *row(*values)], names=["slice", "kind", "ids", "nulls", "shas", "sizes", "texts"])
        k += 1


def _prints(shas: np.ndarray) -> np.ndarray:
    """The leading 64 bits of each digest, as numbers in the order of the digests."""
    return shas[:, :8].copy().view(">u8").ravel().astype(np.uint64)


def _distinct(shas: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints of sorted digests, each row's index among them, and their counts."""
    values = _prints(np.frombuffer(shas, np.uint8).reshape(-1, 32))
    return np.unique(values, return_inverse=True, return_counts=True)


def _send(owners: int):
    def run(batches):
        for batch in batches:
            for name, shas in zip(batch.column(0).to_pylist(), batch.column(1)):
                values, _, count = _distinct(shas.as_py())
                cuts = owner_cuts(values, owners)
                full = np.flatnonzero(np.diff(cuts))
                coded = [rice_encode(values[cuts[o] : cuts[o + 1]]) for o in full]
                repeats = [np.packbits(count[cuts[o] : cuts[o + 1]] > 1).tobytes() for o in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([name] * len(full), pa.int64()), pa.array(np.diff(cuts)[full], pa.int64()), pa.array([k for k, _ in coded], pa.int32()), pa.array([c for _, c in coded], pa.binary()), pa.array(repeats, pa.binary())],
                    names=["owner", "slice", "n", "k", "code", "repeats"],
                )

    return run


def _answer(table: pa.Table) -> pa.Table:
    rows = table.select(["owner", "slice", "n", "k", "code", "repeats"]).to_pylist()
    values = [rice_decode(r["n"], r["k"], r["code"]) for r in rows]
    again = np.concatenate([np.unpackbits(np.frombuffer(r["repeats"], np.uint8))[: r["n"]] for r in rows])
    _, back, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    twice = (count + np.bincount(back, again).astype(np.int64))[back] > 1
    cuts = np.cumsum([0] + [r["n"] for r in rows])
    return pa.table(
        {"slice": pa.array([r["slice"] for r in rows], pa.int64()), "owner": pa.array([r["owner"] for r in rows], pa.int64()), "bitmap": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())}
    )


ROWS = "slice long, pos long, doc_id long, sha string, print long, norm binary"


def _mark(owners: int):
    """A slice's rows; `norm` is the text of a suspect and null for the others."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        held = texts.to_pylist()[0]
        shas, raw = held["shas"], held["texts"]
        values, back, _ = _distinct(shas)
        cuts, twice = owner_cuts(values, owners), np.zeros(len(values), bool)
        for o, bits in zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist()):
            twice[cuts[o] : cuts[o + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[: cuts[o + 1] - cuts[o]]
        suspect = twice[back]
        stop = np.cumsum(np.frombuffer(held["sizes"], np.int64))
        edge = [0, *stop.tolist()]
        n = len(suspect)
        return pa.table(
            {
                "slice": pa.array([held["slice"]] * n, pa.int64()),
                "pos": pa.array(np.arange(n)),
                "doc_id": pa.array(np.frombuffer(held["ids"], np.int64), mask=np.frombuffer(held["nulls"], bool)),
                "sha": pa.array([shas[i : i + 32].hex() for i in range(0, len(shas), 32)], pa.string()),
                "print": pa.array(values[back].view(np.int64)),
                "norm": pa.array([raw[edge[i] : edge[i + 1]] if s else None for i, s in enumerate(suspect.tolist())], pa.binary()),
            }
        )

    return run


# ---------------------------------------------------------------- operator
def verified(suspects: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (sha, print, norm, doc_id, slice, pos) grouped byte by byte: sha, print, group_size, keep_id and first, the place of the row that stays.

    A digest whose texts were all the same bytes names its group; only where it has several do texts come along (other).
    """
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.struct(-F.col("slice"), -F.col("pos")).alias("at"))).alias("best")
    groups = scratch.put("groups", suspects.groupBy("print", "sha", "norm").agg(best, F.count("*").alias("group_size")))
    texts = groups.groupBy(F.col("print").alias("p"), F.col("sha").alias("s")).agg(F.count("*").alias("texts")).filter("texts > 1")
    met = groups.join(texts, (F.col("print") == F.col("p")) & (F.col("sha") == F.col("s")), "left")
    return met.select("print", "sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("at"), F.when(F.col("texts").isNotNull(), F.col("norm")).alias("other"))


def exact_dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark, parts = scratch.spark, parts_for(docs)
    texts = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slices = scratch.put_kinds("slices", texts.mapInArrow(_digest, SLICES), "slice", parts)
    prints = slices.filter(F.col("kind") == PRINTS).select("slice", "shas")
    n = int(prints.agg(F.sum(F.octet_length("shas"))).first()[0] or 0) // 32
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_OWNER))
    sent = prints.mapInArrow(_send(owners), "owner long, slice long, n long, k int, code binary, repeats binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "slice long, owner long, bitmap binary")
    lying = slices.filter(F.col("kind") == TEXTS).drop("kind")
    rows = scratch.put("rows", lying.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_mark(owners), ROWS))
    suspects = rows.filter("norm IS NOT NULL")
    # stored, so that either side of the join is a plain exchange, whose hot keys adaptive execution splits
    found = scratch.put("named", verified(suspects, scratch).withColumnsRenamed({"print": "p", "sha": "s"}))
    # suspects meet their groups by digest; texts are looked at again only under a digest that has several
    same = (F.col("print") == F.col("p")) & (F.col("sha") == F.col("s"))
    several = found.filter("other IS NOT NULL")
    one = suspects.drop("norm").join(found.filter("other IS NULL").drop("other"), same)
    more = suspects.join(several, same & (F.col("norm") == F.col("other"))).drop("norm", "other")
    alone = rows.filter("norm IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    stays = F.col("at") == F.struct(-F.col("slice"), -F.col("pos"))
    return alone.unionByName(one.unionByName(more).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every row of documents."""
    with Scratch(spark, "exact_dedup") as scratch:
        return scratch.finish(exact_dedup(load(spark, sf_dir, "documents"), scratch))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""
