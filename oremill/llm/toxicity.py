"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of the terms that occur in it; a document's is their noisy-or,
1 - prod(1 - p).  Terms are words (A-Z lower-cased) and their first 4, 5 and 6 bytes, which catches inflected forms.

Fitting reads at most TOXIC_ROWS + CLEAN_ROWS labelled documents (a documented bound; drawn by a hash of doc_id, one
row a doc_id), in whole.  Executors count in how many documents of either label each term occurs; terms whose log
likelihood ratio reaches a floor stay, all of them: MIN_GAIN, or in small samples what a term in a quarter of the toxic
documents and no other one reaches.  The driver fits their weights on the sentences that hold any of them.  Scoring is
one pass over all texts, without a shuffle, and locates the sentences at or above the threshold.

Defined results: null and empty texts get the score of a document without sentences, 0; rows of `labels` with a null
doc_id or label are ignored, and a doc_id labelled more than once counts as toxic if any label says so; of rows that
repeat a labelled doc_id the one whose text has the least hash is learned from; without labels of both kinds, or
without a term that tells them apart, every score is 0; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, LOWER, Scratch, byte_rows, find_sorted, flatten, load, narrowed, ragged_arange, word_bounds, word_hashes

TOXIC_ROWS = 4000
CLEAN_ROWS = 8000
MIN_DOCS = 4
MIN_GAIN = 10.0
PREFIXES = (4, 5, 6)
SLICE_BYTES = 4 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True
_FILTER_BITS = 20


@dataclass
class Model:
    terms: np.ndarray  # sorted 64-bit term hashes
    weights: np.ndarray
    bias: float


def term_grid(col):
    """Term hashes (one row of 1 + len(PREFIXES) a word; 0: none), the words' rows' offsets, and the words' sentences.

    Sentences are numbered through the slice: each row starts a new one, and so does every . ! ? or line end.
    """
    buf, offsets = flatten(col)
    low = LOWER[buf]
    starts, ends, bounds = word_bounds(low, offsets, ALNUM_WORD)
    hashes = [word_hashes(low, starts, e) for e in (ends, *[np.minimum(ends, starts + k) for k in PREFIXES])]
    for i, k in enumerate(PREFIXES, 1):
        hashes[i] = np.where(ends - starts > k, hashes[i] ^ np.uint64(0xA5A5A5A5A5A5A5A5 + k), np.uint64(0))
    if len(buf):
        stops = np.concatenate([[0], np.cumsum(_ENDS[buf])])
        sentence = stops[starts] + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    else:
        sentence = np.zeros(0, np.int64)
    return np.stack(hashes, 1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.uint64), bounds, sentence, starts, ends, offsets


def _document_counts(batches):
    for batch in byte_rows(SLICE_BYTES, batches):
        grid, bounds, *_ = term_grid(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        row = np.repeat(np.arange(len(toxic)), np.diff(bounds) * grid.shape[1])
        flat = grid.ravel()
        order = np.lexsort((row, flat))
        flat, row = flat[order], row[order]
        first = np.ones(len(flat), bool)
        first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        flat, bad = flat[first & (flat != 0)], toxic[row[first & (flat != 0)]]
        terms, back = np.unique(flat, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms.view(np.int64)), pa.array(np.bincount(back, bad, len(terms)).astype(np.int64)), pa.array(np.bincount(back, ~bad, len(terms)).astype(np.int64))], names=["term", "bad", "good"]
        )


def _instances(terms: np.ndarray):
    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in byte_rows(SLICE_BYTES, batches):
            grid, bounds, sentence, *_ = term_grid(batch.column(0))
            toxic = batch.column(1).to_pylist()
            hit = find_sorted(terms, grid.ravel())
            at = np.flatnonzero(hit >= 0)
            sent = sentence[at // grid.shape[1]]
            key = np.unique(np.stack([sent, hit[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            per_row = np.array([len(np.unique(sentence[a:b])) for a, b in zip(bounds[:-1], bounds[1:])])
            row_first = np.array([sentence[a] if b > a else -1 for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
            live = np.flatnonzero(row_first >= 0)
            row_of = live[np.searchsorted(row_first[live], key[:, 0], side="right") - 1] if len(key) else np.zeros(0, np.int64)
            cuts = np.searchsorted(row_of, np.arange(len(toxic) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + k + i for i in range(len(toxic))], pa.int64()),
                    pa.array(toxic, pa.int32()),
                    pa.array(per_row, pa.int64()),
                    pa.array([key[a:b, 0].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    pa.array([key[a:b, 1].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ],
                names=["row", "toxic", "sentences", "sents", "terms"],
            )
            k += len(toxic)

    return run


def noisy_or_fit(rows: list, n_terms: int, rounds: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the likelihood of the document labels; rows: (toxic, sentences, sents, terms)."""
    label = np.array([r[0] for r in rows], float)
    sents = [np.frombuffer(r[2], np.int64) for r in rows]
    term = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(s) for s in sents])
    _, sent = np.unique(np.stack([doc, np.concatenate(sents)], 1), axis=0, return_inverse=True) if len(doc) else (None, np.zeros(0, np.int64))
    sent = sent.ravel()
    n_sent = int(sent.max()) + 1 if len(sent) else 0
    sent_doc = np.zeros(n_sent, np.int64)
    sent_doc[sent] = doc
    plain = np.array([r[1] for r in rows]) - np.bincount(sent_doc, minlength=len(rows))
    share = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    x = np.zeros(n_terms + 1)
    x[-1] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        z = x[-1] + np.bincount(sent, x[term], n_sent)
        log_no = -np.logaddexp(0, z)  # log(1 - p) of each sentence that holds a term
        base = -np.logaddexp(0, x[-1])
        total = np.bincount(sent_doc, log_no, len(rows)) + plain * base
        p = np.clip(-np.expm1(total), 1e-12, 1)
        # d/dtotal of the mean negative log likelihood
        slope = share * np.where(label > 0, np.exp(total) / p, -1.0)
        dz = slope[sent_doc] * -(1 / (1 + np.exp(-z)))
        grad = np.bincount(term, dz[sent], n_terms + 1)
        grad[-1] = dz.sum() + (slope * plain).sum() * -(1 / (1 + math.exp(-x[-1])))
        grad[:-1] += l2 * x[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:-1], float(x[-1])


def sample(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """text and toxic of the bounded fitting sample."""
    marked = narrowed(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = [marked.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    chosen = drawn[0].unionByName(drawn[1]).withColumnRenamed("doc_id", "chosen")
    # at most TOXIC_ROWS + CLEAN_ROWS rows of two numbers: a bound that the data cannot exceed
    met = narrowed(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    return met.groupBy("chosen").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, usable: Column | None = None) -> Model:
    """The model, from labelled documents for which `usable` (over doc_id) holds."""
    rows = scratch.put("sample", sample(docs, labels, F.lit(True) if usable is None else usable))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -math.inf)
    if not n.get(1) or not n.get(0):
        scratch.drop("sample")
        return nothing
    quarter = max(2, n[1] // 4)
    floor, least = min(MIN_GAIN, quarter * math.log((n[1] + n[0]) / n[1])), min(MIN_DOCS, quarter)
    counts = rows.mapInArrow(_document_counts, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") + F.col("good") >= least)

    def part(k: str, of: str) -> Column:
        expected = F.lit(float(n[1] if of == "bad" else n[0])) * (F.col("bad") + F.col("good")) / F.lit(float(n[1] + n[0]))
        return F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / expected)).otherwise(0.0)

    gain = part("bad", "bad") + part("good", "good")
    top = counts.withColumn("gain", gain).filter((F.col("gain") >= floor - 1e-9) & (F.col("bad") * float(n[0]) > F.col("good") * float(n[1])))
    terms = np.sort(np.array([r["term"] for r in top.collect()], np.int64).view(np.uint64))
    if not len(terms):
        scratch.drop("sample")
        return nothing
    found = rows.mapInArrow(_instances(terms), "row long, toxic int, sentences long, sents binary, terms binary").orderBy("row").collect()
    weights, bias = noisy_or_fit([(r["toxic"], r["sentences"], r["sents"], r["terms"]) for r in found], len(terms))
    scratch.drop("sample")
    return Model(terms, weights, bias)


def _score(model: Model, threshold: float):
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(model.terms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for batch in byte_rows(SLICE_BYTES, batches):
            names = batch.schema.names
            grid, bounds, sentence, starts, ends, offsets = term_grid(batch.column(names.index("text")))
            flat = grid.ravel()
            at = np.flatnonzero(bits[(flat >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]) if len(model.terms) else np.zeros(0, np.int64)
            hit = find_sorted(model.terms, flat[at])
            at, hit = at[hit >= 0], hit[hit >= 0]
            # sentences that hold words, in order, and the rows' offsets among them
            change = np.ones(len(sentence), bool)
            change[1:] = sentence[1:] != sentence[:-1]
            number = np.cumsum(change) - 1
            first = np.flatnonzero(change)
            rows = np.searchsorted(first, bounds)
            pairs = np.unique(number[at // grid.shape[1]] * np.int64(len(model.terms) or 1) + hit) if len(at) else np.zeros(0, np.int64)
            z = np.full(len(first), model.bias)
            if len(pairs):
                z += np.bincount(pairs // len(model.terms), model.weights[pairs % len(model.terms)], len(first))
            log_no = np.concatenate([[0.0], -np.logaddexp(0, z)])
            total = np.add.reduceat(np.append(log_no[1:], 0.0), np.minimum(rows[:-1], len(first))) if len(rows) > 1 else np.zeros(0)
            total = np.where(np.diff(rows) > 0, total, 0.0)
            score = np.clip(-np.expm1(total), 0.0, 1.0)
            bad = np.flatnonzero(1 / (1 + np.exp(-np.clip(z, -60, 60))) >= threshold)
            last = np.append(first[1:], len(sentence)) - 1
            row_of = np.searchsorted(rows, bad, side="right") - 1
            cuts = np.searchsorted(row_of, np.arange(len(rows)))
            spans = [
                [{"start": int(starts[first[s]] - offsets[i]), "end": int(ends[last[s]] - offsets[i]), "score": float(1 / (1 + math.exp(-min(60.0, z[s]))))} for s in bad[cuts[i] : cuts[i + 1]]]
                for i in range(len(score))
            ]
            new = {"score": pa.array(score, pa.float64()), "offending": pa.array(spans, pa.list_(span))}
            yield pa.RecordBatch.from_arrays([new.get(c) if c in new else batch.column(i) for i, c in enumerate([*names, *new])], names=[*names, *new])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` with score and offending, the byte spans (end exclusive) and scores of sentences at or above the threshold."""
    clash = [c for c in ("score", "offending") if c in docs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(*clash).schema.fields)
    return docs.drop(*clash).mapInArrow(_score(model, threshold), f"{schema}, score double, offending array<struct<start:int,end:int,score:double>>")


def fold(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document, with the byte spans of its offending sentences; rows of fold 0 of 5 are never learned from."""
    docs = narrowed(load(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"), Scratch(spark, "toxicity"), ~fold(F.col("doc_id"), 5, 0))
    return score(docs, model).select("doc_id", fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


ORACLE = None  # learned; the tests measure held-out accuracy
